import json

import pytest

from tarnflow.sources import ingest


def test_csv(spark, tmp_path):
    (tmp_path / "g1.csv").write_text("date,q_cms\n2000-01-01,1.5\n2000-01-01,9\n2000-01-02,-999\n2000-01-03,x\n2000-01-04,\n")
    got = {str(r.d): r.q for r in ingest.read_daily_csv(spark, str(tmp_path)).collect()}
    assert got == {"2000-01-01": 1.5, "2000-01-02": None, "2000-01-03": None, "2000-01-04": None}
    (tmp_path / "g1.csv").write_text("date,q_cms\n2000-01-01,-1\n")
    with pytest.raises(Exception, match="negative flow"):
        ingest.read_daily_csv(spark, str(tmp_path)).collect()


def test_geojson(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": square}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square["coordinates"]]}}]}))
    got = ingest.read_geojson(spark, str(tmp_path)).collect()
    assert len(got) == 8 and len({r.ring for r in got}) == 2 and {r.basin_id for r in got} == {"b"}


def test_digests(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"hello\n")
    got = ingest.file_digests(spark, str(tmp_path))
    assert got.first().blob_sha1 == "ce013625030ba8dba906f756967f9e9ca394464a"
    want = spark.createDataFrame([("x", got.first().sha256), ("y", "0"), ], "name string, sha256 string")
    assert {r.name: r.status for r in ingest.verify(got, want).collect()} == {"x": "ok", "y": "missing"}
