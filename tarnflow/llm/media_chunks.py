"""Media columns with content-defined chunks: every payload is a list of chunks, every distinct chunk is stored once.

A payload is the text as UTF-8 with zero bytes up to a multiple of 64.  A rolling gear hash over the last 32 bytes cuts
it, so the same content is cut alike wherever it stands.  Chunks are named by digest.  Spark joins find the digests that
more than one text uses; their chunks go to chunk rows, each written by one owner, all others stay in the row of their
text.  Equal texts, by 128-bit digest, are one payload.  The stored form of a payload, its media, is the head that its row
holds (an ordered list of digests and lengths, in bytes) and the bytes of those chunks, wherever they are stored.

Reading back parses the stored head, puts the payload together from its row and the chunk rows that the head names, checks
every chunk against its digest, and computes digests and features from what was read.  Only texts that share chunks are
shuffled for it; a chunk that very many texts share is joined to narrow rows, whose large partitions Spark splits.

What each row must do is a table of ids, far smaller than the texts; it is broadcast while it is below
``BROADCAST_ROWS`` rows and shuffled with the texts beyond.

Null or empty text: 64 zero bytes.  Null ids count as smaller than all others.  Rows that repeat an id and text give
repeated rows.  An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import _base, graph
from tarnflow.llm.line_dedup import NO_ID

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 16_384, 11
WINDOW = 32  #: bytes that the rolling hash looks at; less than the shortest chunk
ALIGN = 64
BROADCAST_ROWS = 300_000  #: rows of about 80 bytes
#: One random number for each byte, from a fixed seed.
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % ALIGN or (0 if text else ALIGN))


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    h, s = GEAR[raw], 1
    while s < WINDOW:
        then = h.copy()
        then[s:] += h[:-s] << np.uint32(s)
        h, s = then, 2 * s
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, base, at = [], 0, 0
    for p in payloads:
        start, end, ends = base, base + len(p), []
        while end - start > MIN_CHUNK:
            at = bisect_left(marks, start + MIN_CHUNK, at)
            cut = min(marks[at] if at < len(marks) else end, start + MAX_CHUNK, end)
            ends.append(cut - base)
            start = cut
        if start < end:
            ends.append(end - base)
        out.append(ends)
        base = end
        at = bisect_left(marks, base)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunked(payloads: list[bytes]) -> list[list[bytes]]:
    return [[p[a:z] for a, z in zip([0, *ends], ends)] for p, ends in zip(payloads, cuts(payloads))]


def chunk_list(n_bytes: int, names: list[bytes], lengths: list[int]) -> bytes:
    """The head of the stored form."""
    return b"CDC1" + struct.pack("<QI", n_bytes, len(names)) + b"".join(d + struct.pack("<I", n) for d, n in zip(names, lengths))


def parsed(head: bytes) -> tuple[int, list[bytes], list[int]]:
    """Bytes of the text, names and lengths of its chunks."""
    if head[:4] != b"CDC1":
        raise ValueError("not a chunk list")
    n_bytes, k = struct.unpack_from("<QI", head, 4)
    entries = [struct.unpack_from("<16sI", head, 16 + 20 * i) for i in range(k)]
    return n_bytes, [d for d, _ in entries], [n for _, n in entries]


def feature(samples: np.ndarray) -> str:
    """Sum, energy, crossings of the middle and largest step of the 8-bit samples."""
    x = samples.astype(np.int64)
    high = samples > 127
    return f"{x.sum()}:{(x * x).sum()}:{int((high[1:] != high[:-1]).sum())}:{int(np.abs(np.diff(x)).max(initial=0))}"


def _manifests(keyed: DataFrame) -> DataFrame:
    """``(doc_id, key, n_bytes, names)``; within a task only the first row of a text has the names of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in _base.sliced(batches, limit=8 << 20):
            texts, names = b.column("text").cast(pa.binary()).to_pylist(), [None] * b.num_rows
            new = []
            for i, key in enumerate(b.column("key").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if len(seen) > 200_000:
                seen.clear()
            for i, chunks in zip(new, chunked([padded(texts[i]) for i in new])):
                names[i] = [digest(c) for c in chunks]
            yield _base.record_batch(["doc_id", "key", "n_bytes", "names"], [b.column("doc_id"), b.column("key"), pa.array(map(len, texts), pa.int64()), pa.array(names, pa.list_(pa.binary()))])

    return keyed.mapInArrow(run, "doc_id long, key binary, n_bytes long, names array<binary>")


def _roles(rows: DataFrame) -> DataFrame:
    """``(role_id, role_key, writes, shared)``: only rows that are later copies, or texts with shared chunks.

    ``shared`` lists the positions of shared chunks, and whether this text is the one that stores the chunk.
    """
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("rep"))
    refs = _base.materialize(rows.where("names IS NOT NULL").dropDuplicates(["key"]).select("key", F.posexplode("names").alias("pos", "name")), "chunk-names")
    owners = refs.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("owner")).where("n > 1").select("name", "owner")
    marked = refs.join(owners, "name").select("key", F.struct("pos", (F.struct("key", "pos") == F.col("owner")).alias("mine")).alias("c"))
    shared = marked.groupBy("key").agg(F.array_sort(F.collect_list("c")).alias("shared"))
    every = rows.select("doc_id", "key").distinct().join(reps, "key").join(shared, "key", "left")
    return every.where("doc_id <> rep OR shared IS NOT NULL").select(F.col("doc_id").alias("role_id"), F.col("key").alias("role_key"), (F.col("doc_id") == F.col("rep")).alias("writes"), "shared")


def _store(keyed: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows of texts (key, chunk names and lengths, shared positions, the bytes of all other chunks) and of shared chunks."""
    side = F.broadcast(roles) if roles.count() <= BROADCAST_ROWS else roles
    joined = keyed.join(side, (F.col("doc_id") == F.col("role_id")) & (F.col("key") == F.col("role_key")), "left").select("key", "text", "writes", "shared")
    names = ["key", "name", "head", "shared", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.sliced(batches, limit=8 << 20):
            b = b.filter(pa.array([w is not False for w in b.column("writes").to_pylist()]))
            texts = b.column("text").cast(pa.binary()).to_pylist()
            out = []
            for key, text, chunks, shared in zip(b.column("key").to_pylist(), texts, chunked(list(map(padded, texts))), b.column("shared").to_pylist()):
                at = {c["pos"]: c["mine"] for c in shared or ()}
                own = [digest(c) for c in chunks]
                out += [(None, own[i], None, None, chunks[i]) for i, mine in at.items() if mine]
                out.append((key, None, chunk_list(len(text), own, list(map(len, chunks))), sorted(at), b"".join(c for i, c in enumerate(chunks) if i not in at)))
            types = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
            yield _base.record_batch(names, [pa.array([r[i] for r in out], t) for i, t in enumerate(types)])

    return joined.mapInArrow(run, "key binary, name binary, head binary, shared array<int>, bytes binary")


_READ = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_READ_SCHEMA = "key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def reconstruct(names: list[bytes], lengths: list[int], kept: bytes, foreign: dict[int, bytes]) -> bytes:
    """The payload, every chunk checked against its name."""
    chunks, at = [], 0
    for i, (name, n) in enumerate(zip(names, lengths)):
        c = foreign.get(i)
        if c is None:
            c, at = kept[at : at + n], at + n
        if len(c) != n or digest(c) != name:
            raise ValueError("a stored chunk is damaged")
        chunks.append(c)
    return b"".join(chunks)


def _described(key: bytes, head: bytes, kept: bytes, foreign: dict[int, bytes]) -> tuple:
    n_bytes, names, lengths = parsed(head)
    payload = reconstruct(names, lengths, kept, foreign)
    media = hashlib.sha256(head)
    media.update(payload)
    return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(head) + len(payload), media.hexdigest(), feature(np.frombuffer(payload, np.uint8))


def _as_batch(out: list[tuple]) -> pa.RecordBatch:
    return _base.record_batch(_READ, [pa.array([r[i] for r in out], pa.binary() if c == "key" else pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for i, c in enumerate(_READ)])


def read_back(store: DataFrame) -> DataFrame:
    """Digests and features of every stored payload, computed from the stored bytes."""
    texts = store.where("key IS NOT NULL")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.sliced(batches, "bytes"):
            yield _as_batch([_described(k, head, kept, {}) for k, head, kept in zip(*(c.to_pylist() for c in b.columns))])

    simple = texts.where("size(shared) = 0").select("key", "head", "bytes").mapInArrow(alone, _READ_SCHEMA)
    sharing = texts.where("size(shared) > 0")
    # an entry of the head has 16 bytes of digest and 4 of length, after 16 bytes
    wanted = sharing.select("key", "head", F.explode("shared").alias("pos")).select("key", "pos", F.expr("substring(head, 17 + 20 * pos, 16)").alias("name"))
    pieces = wanted.join(store.where("key IS NULL").select("name", "bytes"), "name").selectExpr("key", "pos", "CAST(NULL AS binary) AS head", "bytes")
    both = sharing.selectExpr("key", "-1 AS pos", "head", "bytes").union(pieces)
    n_parts = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, foreign = None, {}
        for b in batches:
            out = []
            for key, pos, head, data in zip(*(c.to_pylist() for c in b.columns)):
                if pos >= 0:
                    foreign[pos] = data
                elif now is None or key != now[0]:
                    if now:
                        out.append(_described(*now, foreign))
                    now, foreign = (key, head, data), {}
            yield _as_batch(out)
        if now:
            yield _as_batch([_described(*now, foreign)])

    joined = both.repartition(n_parts, "key").sortWithinPartitions("key", "pos").mapInArrow(assembled, _READ_SCHEMA)
    return simple.union(joined)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of each row."""
    _base.batches_of(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    began = _base.mark()
    rows = _base.materialize(_manifests(keyed), "manifests")
    roles = _base.materialize(_roles(rows), "roles")
    graph.release(rows)
    store = _base.materialize(_store(keyed, roles), "media")
    graph.release(rows)
    found = _base.materialize(read_back(store).dropDuplicates(["key"]), "described")
    graph.release(rows)
    _base.discard(began, rows, found)
    return rows.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "key").join(found, "key").select("doc_id", *_READ[1:])
