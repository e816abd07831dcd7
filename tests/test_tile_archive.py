"""Tile archives: ids by the published examples, directories, round trips, merges and refusals."""

import pytest
from pyspark.sql import functions as F

from tarnflow.sources import tile_archive as ta


def test_ids(spark):
    known = [(0, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 3), (1, 1, 0, 4), (2, 0, 0, 5), (2, 1, 1, 7), (2, 3, 0, 20), (12, 3423, 1763, 19078479)]
    df = spark.createDataFrame(known, "z int, x int, y int, want long")
    assert all(r.want == r.got for r in df.select("want", ta.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("got")).collect())
    every = spark.range(4**5).select(ta.tile_id(F.lit(5), F.col("id") % 32, F.floor(F.col("id") / 32)).alias("t"))
    assert every.distinct().count() == 4**5 and every.agg(F.min("t")).first()[0] == (4**5 - 1) // 3


def test_directories():
    many = [(k * 3, 1 + k % 2, k * 50 + (k % 7 == 0), 50 + k % 300 * 40) for k in range(30_000)]
    assert ta.entries_of(ta.directory(many)) == many
    assert ta.entries_of(ta.directory([])) == []
    root, leaves = ta._directories(many)
    assert len(root) <= ta.ROOM - ta.HEAD
    assert [e for _, run, at, n in ta.entries_of(root) for e in ta.entries_of(leaves[at : at + n])] == many
    assert [ta._zoom(t) for t in (0, 1, 4, 5, 20, 21)] == [0, 1, 1, 2, 2, 3]


def _set(spark, name, ids, at, per_file=7):
    df = spark.createDataFrame([(t, f"{name}{t // 3};".encode()) for t in ids], "tile_id long, blob binary")
    return ta.write(df, f"file://{at}/{name}", {"vector_layers": [{"id": name}]}, (float(min(ids)), 0.0, 9.0, 8.0), per_file)


def test_merge(spark, tmp_path):
    a, b = _set(spark, "a", range(0, 40), tmp_path), _set(spark, "b", range(20, 55, 2), tmp_path)
    assert a.count() == 6 and a.agg(F.sum("n_tiles"), F.sum("n_entries")).first()[0] == 40
    assert a.agg(F.sum("n_entries")).first()[0] < 40  # runs
    sets = [[r.path for r in s.collect()] for s in (a, b)]
    got = ta.merge(spark, sets, f"file://{tmp_path}/ab", 16, name="both")
    want = {t: (f"a{t // 3};" if t < 40 else "") + (f"b{t // 3};" if t in range(20, 55, 2) else "") for t in {*range(40), *range(20, 55, 2)}}
    assert {r.tile_id: bytes(r.blob).decode() for r in ta.tiles(got).collect()} == want
    ranges = sorted((r.first_id, r.last_id) for r in got.collect())
    assert len(ranges) == 3 and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    h = ta.heads(got).first()
    assert (h.west, h.east, h.kind) == (0.0, 9.0, ta.VECTOR) and '"name": "both"' in h.metadata
    some = spark.createDataFrame([(21,), (22,), (999,)], "tile_id long")
    assert {r.tile_id for r in ta.tiles(got, some).collect()} == {21, 22}
    left = [p.name for p in tmp_path.rglob("*.contents")]
    assert not left


def test_refusals_and_empty(spark, tmp_path):
    a = [r.path for r in _set(spark, "a", [1, 2], tmp_path).collect()]
    with pytest.raises(ValueError, match="several sets"):
        ta.merge(spark, [a, a], f"file://{tmp_path}/aa")
    with pytest.raises(ValueError, match="no archives"):
        ta.merge(spark, [], f"file://{tmp_path}/none")
    plain = ta.write(spark.createDataFrame([(1, None)], "tile_id long, blob binary"), f"file://{tmp_path}/p", {})
    assert bytes(ta.tiles(plain).first().blob) == b""
    with pytest.raises(ValueError, match="vector_layers"):
        ta.merge(spark, [[plain.first().path]], f"file://{tmp_path}/pp")
    assert ta.write(spark.createDataFrame([], "tile_id long, blob binary"), f"file://{tmp_path}/e", {}).count() == 0
