"""Archives of map tiles, version 3 of the published single-file layout: header, directories, metadata, tile contents.

Tiles are rows ``(tile_id, blob)``; ``tile_id`` numbers tiles along a Hilbert curve, level by level.  An archive holds one
range of ids and is complete by itself, so a large tile set is a folder of archives and no task or file holds all of it.
A task streams its contents to a side file, as the directories before them need their sizes, under a name of its own
attempt; only files that finished tasks report are in the table that ``write`` returns.  Readers fetch the header and the
root directory, then deal the leaf directories, then ranges of contents, out to tasks.

An empty tile set gives no archive; equal contents of neighbouring ids are one entry; a null blob is an empty one.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators.network import saved

#: Fixed values of the layout: magic and version, the header's fields, room for header and root, codes of compressions and of vector tiles.
MAGIC, HEADER, ROOM, GZIP, VECTOR = b"PMTiles\x03", "<8s11Q6B4iB2i", 16384, 2, 1
HEAD = struct.calcsize(HEADER)
LEAF = 4096  #: entries of a leaf directory
PER_FILE = 1 << 20  #: tiles of an archive
COPY = 4 << 20


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """The number of a tile: all tiles of lower levels, then its place on the Hilbert curve of its level."""
    one = F.lit(1).cast("long")
    left = lambda v, k: F.call_function("shiftleft", v, k)
    bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(one)

    def step(s: Column, k: Column) -> Column:
        side = left(one, k)
        rx, ry = bit(s["x"], k), bit(s["y"], k)
        low_x, low_y = s["x"].bitwiseAND(side - 1), s["y"].bitwiseAND(side - 1)
        turn = lambda a, b: F.when(ry == 1, a).when(rx == 1, side - 1 - b).otherwise(b)
        return F.struct(turn(low_x, low_y).alias("x"), turn(low_y, low_x).alias("y"), (s["d"] + side * side * (rx * 3).bitwiseXOR(ry)).alias("d"))

    z = z.cast("int")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    bits = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    lower = F.floor((left(one, 2 * z) - 1) / 3).cast("long")
    return F.aggregate(bits, start, step, lambda s: s["d"]) + lower


def varints(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries ``(tile_id, run, offset, length)`` in columns: differences of ids, runs, lengths, offsets (0: right after the last one)."""
    ids, runs, offsets, lengths = (list(c) for c in zip(*entries)) if entries else ([], [], [], [])
    steps = [b - a for a, b in zip([0, *ids], ids)]
    follows = [bool(i) and offsets[i] == offsets[i - 1] + lengths[i - 1] for i in range(len(ids))]
    places = [0 if f else o + 1 for f, o in zip(follows, offsets)]
    return gzip.compress(varints([len(ids), *steps, *runs, *lengths, *places]), mtime=0)


def entries_of(data: bytes) -> list[tuple[int, int, int, int]]:
    values, now, shift = [], 0, 0
    for b in gzip.decompress(data):
        now |= (b & 127) << shift
        shift += 7
        if b < 128:
            values.append(now)
            now = shift = 0
    n = values[0]
    steps, runs, lengths, places = (values[1 + k * n : 1 + (k + 1) * n] for k in range(4))
    out, at, end = [], 0, 0
    for step, run, length, place in zip(steps, runs, lengths, places):
        at += step
        begin = place - 1 if place else end
        end = begin + length
        out.append((at, run, begin, length))
    return out


def _directories(entries: list[tuple[int, int, int, int]]) -> tuple[bytes, bytes]:
    """The root and the leaves: larger leaves until the root has room."""
    root, leaves, size = directory(entries), b"", LEAF
    while len(root) > ROOM - HEAD:
        pointers, parts, at = [], [], 0
        for k in range(0, len(entries), size):
            parts.append(directory(entries[k : k + size]))
            pointers.append((entries[k][0], 0, at, len(parts[-1])))
            at += len(parts[-1])
        root, leaves, size = directory(pointers), b"".join(parts), size * 2
    return root, leaves


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _zoom(t: int) -> int:
    return ((3 * t + 1).bit_length() - 1) // 2


def write(tiles: DataFrame, folder: str, metadata: dict, bounds: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0), per_file: int = PER_FILE) -> DataFrame:
    """Write ``tiles (tile_id, blob)``, ids unique, to archives of about ``per_file`` tiles below ``folder``.

    The table ``(path, first_id, last_id, n_tiles, n_entries, n_bytes)`` of finished archives comes back.
    """
    corners = [round(v * 1e7) for v in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder.rstrip('/')}/tiles-{uuid.uuid4().hex}"
        files, at = _open(name)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        entries, last, offset, n_tiles, n_contents = [], None, 0, 0, 0
        with files.open_output_stream(f"{at}.contents") as side:
            for b in batches:
                for t, blob in zip(b.column("tile_id").to_pylist(), b.column("blob").to_pylist()):
                    blob = gzip.compress(blob or b"", mtime=0)
                    n_tiles += 1
                    if entries and blob == last and t == entries[-1][0] + entries[-1][1]:
                        entries[-1] = (entries[-1][0], entries[-1][1] + 1, *entries[-1][2:])
                        continue
                    entries.append((t, 1, offset, len(blob)))
                    side.write(blob)
                    last, offset, n_contents = blob, offset + len(blob), n_contents + 1
        if entries:
            root, leaves = _directories(entries)
            meta = gzip.compress(json.dumps(metadata, sort_keys=True).encode(), mtime=0)
            places = [HEAD]
            for part in (root, meta, leaves):
                places.append(places[-1] + len(part))
            end = entries[-1][0] + entries[-1][1] - 1
            low, high = _zoom(entries[0][0]), _zoom(end)
            centre = [(corners[0] + corners[2]) // 2, (corners[1] + corners[3]) // 2]
            head = struct.pack(HEADER, MAGIC, places[0], len(root), places[1], len(meta), places[2], len(leaves), places[3], offset, n_tiles, len(entries), n_contents, 1, GZIP, GZIP, VECTOR, low, high, *corners, low, *centre)
            with files.open_output_stream(f"{at}.pmtiles") as out, files.open_input_stream(f"{at}.contents") as side:
                out.write(head + root + meta + leaves)
                while chunk := side.read(COPY):
                    out.write(chunk)
            row = [f"{name}.pmtiles", entries[0][0], end, n_tiles, len(entries), places[3] + offset]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["path", "first_id", "last_id", "n_tiles", "n_entries", "n_bytes"])
        files.delete_file(f"{at}.contents")

    n = max(1, -(-tiles.count() // per_file))
    dealt = tiles.select(F.col("tile_id").cast("long").alias("tile_id"), "blob").repartitionByRange(n, "tile_id").sortWithinPartitions("tile_id")
    return saved(dealt.mapInArrow(run, "path string, first_id long, last_id long, n_tiles long, n_entries long, n_bytes long"))


def heads(archives: DataFrame) -> DataFrame:
    """``archives (path, ...)`` with what their headers and metadata say."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path in f["path"]:
                files, at = _open(path)
                with files.open_input_file(at) as src:
                    h = struct.unpack(HEADER, src.read(HEAD))
                    if h[0] != MAGIC:
                        raise ValueError(f"{path} is not an archive of tiles of version 3")
                    src.seek(h[3])
                    meta = src.read(h[4])
                    rows.append((path, h[1], h[2], h[5], h[7], h[13], h[14], h[15], *(v / 1e7 for v in h[18:22]), (gzip.decompress(meta) if h[13] == GZIP else meta).decode()))
            yield pd.DataFrame(rows, columns=["path", "root_at", "root_length", "leaves_at", "contents_at", "inner", "compression", "kind", "west", "south", "east", "north", "metadata"])

    return archives.select("path").distinct().mapInPandas(run, "path string, root_at long, root_length long, leaves_at long, contents_at long, inner int, compression int, kind int, west double, south double, east double, north double, metadata string")


def entries(archives: DataFrame) -> DataFrame:
    """``(path, tile_id, run, at, length, compression)`` of all directories, ``at`` counted from the file's start."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                files, at = _open(r.path)
                with files.open_input_file(at) as src:
                    src.seek(r.dir_at)
                    e = pd.DataFrame(entries_of(src.read(r.dir_length)), columns=["tile_id", "run", "offset", "length"])
                yield e.assign(path=r.path, leaves_at=r.leaves_at, contents_at=r.contents_at, compression=r.compression)

    kind = "tile_id long, run long, offset long, length long, path string, leaves_at long, contents_at long, compression int"
    at = lambda df: df.select("path", "tile_id", "run", (F.col("contents_at") + F.col("offset")).alias("at"), "length", "compression")
    root = saved(heads(archives).withColumnsRenamed({"root_at": "dir_at", "root_length": "dir_length"}).mapInPandas(run, kind))
    leaves = root.where("run = 0").select("path", (F.col("leaves_at") + F.col("offset")).alias("dir_at"), F.col("length").alias("dir_length"), "leaves_at", "contents_at", "compression")
    return at(root.where("run > 0")).union(at(leaves.repartition("path", "dir_at").mapInPandas(run, kind)))


def tiles(archives: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(path, tile_id, blob)`` of all tiles, or of the ids ``wanted (tile_id)`` alone; contents are read in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = src = None
        for b in batches:
            blobs = []
            for p, at, length, compression in zip(*(b.column(c).to_pylist() for c in ("path", "at", "length", "compression"))):
                if p != path:
                    if src is not None:
                        src.close()
                    files, inside = _open(p)
                    path, src = p, files.open_input_file(inside)
                src.seek(at)
                data = src.read(length)
                blobs.append(gzip.decompress(data) if compression == GZIP else data)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("tile_id"), pa.array(blobs, pa.binary())], names=["path", "tile_id", "blob"])
        if src is not None:
            src.close()

    e = entries(archives).withColumn("tile_id", F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run") - 1)))
    if wanted is not None:
        e = e.join(wanted.select("tile_id").distinct(), "tile_id", "left_semi")
    return e.repartitionByRange("path", "at").sortWithinPartitions("path", "at").mapInArrow(run, "path string, tile_id long, blob binary")


def merge(spark: SparkSession, sources: list[list[str]], folder: str, per_file: int = PER_FILE, **extra) -> DataFrame:
    """Join tile sets, each a list of archives, into one: contents of an id are put one after the other in the order of the
    sets, which unites the layers of vector tiles.  Refused: other tiles than vector ones, different compressions, a set
    without layers, a layer's name in two sets.  Bounds are united."""
    paths = spark.createDataFrame([(k, p) for k, s in enumerate(sources) for p in s], "k int, path string")
    known = heads(paths).join(paths, "path").orderBy("k", "path").toPandas()  # a row an archive
    if known.empty:
        raise ValueError("no archives to merge")
    if (known["kind"] != VECTOR).any() or known["compression"].nunique() > 1:
        raise ValueError("archives must hold vector tiles of one compression")
    layers: list[dict] = []
    for k, group in known.groupby("k"):
        own = {layer["id"]: layer for m in group["metadata"] for layer in json.loads(m).get("vector_layers") or []}
        twice = sorted({layer["id"] for layer in layers} & set(own))
        if not own or twice:
            raise ValueError(f"layer names in several sets: {twice}" if twice else f"set {k} names no vector_layers")
        layers += own.values()
    bounds = (known["west"].min(), known["south"].min(), known["east"].max(), known["north"].max())
    parts = tiles(paths).join(paths, "path").groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("k", "path", "blob"))).alias("p"))
    joined = parts.select("tile_id", F.aggregate("p", F.lit(b""), lambda a, s: F.concat(a, s["blob"])).alias("blob"))
    return write(saved(joined), folder, {**json.loads(known["metadata"][0]), "vector_layers": layers, **extra}, bounds, per_file)
