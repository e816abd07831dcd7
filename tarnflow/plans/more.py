"""More queries over the test tables, each with its SQL: anchors, windows, lookups, provenance, routing and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import baseflow, frequency, geodesy, landsoil, network, periods, reliability, routing, runoff, series, signatures, terrain, uncertainty
from tarnflow.plans.hydro import _CN_SQL, _GRID, _MAXIMA, DAILY, PAIRED, QUERIES, SHARE, SQL, _all_regions, _cells, _grid, _maxima, daily_flow, precipitation, query, report_sql, rounded_signatures, table

__all__ = ["QUERIES", "SQL"]


@query("SELECT p_partkey, CASE WHEN x < 2 THEN 'low' WHEN x < 10 THEN 'moderate' WHEN x < 50 THEN 'high' ELSE 'severe' END AS severity FROM (SELECT p_partkey, p_size * p_size / 20.0 AS x FROM part)")
def soil_loss_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", runoff.severity(s * s / 20.0).alias("severity"))


_POINT = "x AS (SELECT p_partkey, -179.5 + (p_partkey * 7 % 3590) / 10.0 AS lon, -80 + (p_partkey * 13 % 1600) / 10.0 AS lat, CASE WHEN p_size > 5 THEN p_size * 3.0 END AS e FROM part)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (-179.5 + (k * 7 % 3590) / 10.0).alias("lon"), (-80 + (k * 13 % 1600) / 10.0).alias("lat"), F.when(F.col("p_size") > 5, F.col("p_size") * 3.0).alias("e"))


@query(f"""WITH {_POINT}, h AS (SELECT *, 1.2 * CASE WHEN e > 0 THEN least(30, greatest(3, 1.5 * sqrt(e))) ELSE 3 END AS half FROM x), d AS (SELECT *, half / 111.32 AS dy, half / greatest(111.32 * cos(radians(lat)), 1e-6) AS dx FROM h)
SELECT p_partkey, CASE WHEN lon BETWEEN -126 AND -65 AND lat BETWEEN 23 AND 50.5 THEN 'EPSG:5070' ELSE 'EPSG:' || CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS VARCHAR) END AS metric_system,
round(half, 6) AS half_km, round(greatest(-180, lon - dx), 8) AS x0, round(greatest(-90, lat - dy), 8) AS y0, round(least(180, lon + dx), 8) AS x1, round(least(90, lat + dy), 8) AS y1,
round(least(20, greatest(3, 2 * sqrt(greatest(coalesce(e, 0), 0)))), 6) AS local_km, round(0.0025 * 0.005 * 111.32 * 111.32 * cos(radians(lat)), 10) AS cell_km2 FROM d""")
def point_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    x = _points(spark, sf_dir).withColumn("half", geodesy.search_half_km(F.col("e")))
    box = geodesy.box_around(lon, lat, F.col("half"))
    return x.select(
        "p_partkey", geodesy.metric_system(lon, lat).alias("metric_system"), F.round("half", 6).alias("half_km"), *(F.round(v, 8).alias(n) for n, v in box.items()),
        F.round(geodesy.local_half_km(F.coalesce("e", F.lit(0.0))), 6).alias("local_km"), F.round(geodesy.cell_km2(F.lit(-0.0025), F.lit(0.005), lat), 10).alias("cell_km2"),
    )


_RING = "v AS (SELECT s_suppkey AS basin_id, k AS seq, -100 + s_suppkey % 20 + cos(radians(k * 45)) * (0.5 + s_suppkey % 7 / 10.0) AS lon, 40 + s_suppkey % 5 + sin(radians(k * 45)) * (0.4 + s_suppkey % 3 / 10.0) AS lat FROM supplier, generate_series(0, 7) g(k))"
_Q = lambda e2, s: f"((1 - {e2}) * ({s} / (1 - {e2} * {s} * {s}) - ln((1 - sqrt({e2}) * {s}) / (1 + sqrt({e2}) * {s})) / (2 * sqrt({e2}))))"
_W, _G = "0.0066943799901413165", "0.0066943800229007876"
_M2 = lambda d: f"(cos(radians({d})) ** 2 / (1 - {_G} * sin(radians({d})) ** 2))"


@query(f"""WITH {_RING}, k AS (SELECT cos(pi() / 6) / sqrt(1 - {_W} * 0.25) AS k0, ({_M2(29.5)} - {_M2(45.5)}) / ({_Q(_G, 'sin(radians(45.5))')} - {_Q(_G, 'sin(radians(29.5))')}) AS n), c AS (SELECT *, {_M2(29.5)} + n * {_Q(_G, 'sin(radians(29.5))')} AS c FROM k),
p AS (SELECT basin_id, seq, 6378137.0 * k0 * radians(lon) AS x, 6378137.0 * {_Q(_W, 'sin(radians(lat))')} / (2 * k0) AS y, 6378137.0 * sqrt(c - n * {_Q(_G, 'sin(radians(lat))')}) / n * sin(n * radians(lon + 96)) AS ax, -6378137.0 * sqrt(c - n * {_Q(_G, 'sin(radians(lat))')}) / n * cos(n * radians(lon + 96)) AS ay FROM v, c),
e AS (SELECT a.*, b.x AS x2, b.y AS y2, b.ax AS ax2, b.ay AS ay2 FROM p a JOIN p b ON b.basin_id = a.basin_id AND b.seq = (a.seq + 1) % 8),
m AS (SELECT basin_id, abs(sum(x * y2 - x2 * y)) / 2e6 AS area, sum((ax + ax2) * (ax * ay2 - ax2 * ay)) / (3 * sum(ax * ay2 - ax2 * ay)) AS cx, sum((ay + ay2) * (ax * ay2 - ax2 * ay)) / (3 * sum(ax * ay2 - ax2 * ay)) AS cy FROM e GROUP BY 1),
o AS (SELECT basin_id, ax AS ox, ay AS oy FROM p WHERE seq = 0), l AS (SELECT p.basin_id, max(sqrt((ax - ox) ** 2 + (ay - oy) ** 2)) / 1000 AS len FROM p JOIN o ON o.basin_id = p.basin_id GROUP BY 1)
SELECT m.basin_id, round(area, 4) AS area_km2, round(len, 5) AS length_km, round(sqrt((cx - ox) ** 2 + (cy - oy) ** 2) / 1000, 4) AS centroid_km FROM m JOIN o ON o.basin_id = m.basin_id JOIN l ON l.basin_id = m.basin_id""")
def basin_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s_suppkey"), F.col("seq")
    x = table(spark, sf_dir, "supplier").select(s, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq"))
    v = x.select(s.alias("basin_id"), "seq", (-100 + s % 20 + F.cos(F.radians(k * 45)) * (0.5 + s % 7 / 10.0)).alias("lon"), (40 + s % 5 + F.sin(F.radians(k * 45)) * (0.4 + s % 3 / 10.0)).alias("lat"))
    b = geodesy.basin_measures(v, v.where("seq = 0").select("basin_id", "lon", "lat"))
    return b.select("basin_id", F.round("area_km2", 4).alias("area_km2"), F.round("length_km", 5).alias("length_km"), F.round("centroid_km", 4).alias("centroid_km"))


@query("""WITH x AS (SELECT s_suppkey, -120 + s_suppkey % 37 / 7.0 AS lon, 30 + s_suppkey % 41 / 9.0 AS lat, CASE WHEN s_suppkey % 5 = 0 THEN 'x' || s_suppkey WHEN s_suppkey % 3 > 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS site, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey * 11 END AS unit, CASE WHEN s_suppkey % 2 = 0 THEN 'v2' END AS ver FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_full_match(site, '[0-9]{8,15}') THEN concat_ws('|', 'gauge_index', 'nhdplusv2', coalesce(ver, 'unversioned'), 'usgs:' || site) END AS gauge, CASE WHEN unit IS NOT NULL THEN concat_ws('|', 'network_element', 'merit', coalesce(ver, 'unversioned'), unit) END AS unit,
concat_ws('|', 'grid_cell', 'dem', coalesce(ver, 'unversioned'), 'EPSG:4326', '3as', CAST(floor((lon + 180) / (3 / 3600.0::DOUBLE) + 1e-9) AS BIGINT), CAST(floor((lat + 90) / (3 / 3600.0::DOUBLE) + 1e-9) AS BIGINT)) AS cell,
concat_ws(',', CASE WHEN regexp_full_match(site, '[0-9]{8,15}') THEN 'usgs:' || site END, CASE WHEN unit IS NOT NULL THEN 'comid:' || unit END) AS aliases FROM x""")
def basin_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    site = F.when(s % 5 == 0, F.concat(F.lit("x"), s.cast("string"))).when(s % 3 > 0, F.lpad(s.cast("string"), 8, "0"))
    unit, version = F.when(s % 4 > 0, s * 11), F.when(s % 2 == 0, "v2")
    names = F.transform(reliability.aliases(site, unit, F.lit(None).cast("string")), lambda a: F.concat_ws(":", a["scheme"], a["value"]))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", reliability.gauge_anchor(site, version).alias("gauge"), reliability.unit_anchor("merit", unit, version).alias("unit"),
        reliability.grid_anchor(-120 + s % 37 / 7.0, 30 + s % 41 / 9.0, 90.0, "dem", version).alias("cell"), F.array_join(names, ",").alias("aliases"),
    )


_MESSAGES = ["ok", "HTTP 503 from service", "status code: 501", "404 not found", "502, message='Bad Gateway'", "request timed out", "Timeout of nothing", "Connection reset by peer", "Too Many Requests", "no data here", "status=429", "http408"]


@query(f"""WITH x AS (SELECT p_partkey, {_MESSAGES!r}[p_partkey % 12 + 1] AS m, CASE WHEN p_partkey % 4 = 0 THEN 399 + p_partkey % 220 END AS s, CASE WHEN p_partkey % 29 = 0 THEN 'NLDI_UNAVAILABLE' WHEN p_partkey % 31 = 0 THEN 'NLDI_NOT_FOUND' END AS c FROM part)
SELECT p_partkey, CASE WHEN c = 'NLDI_UNAVAILABLE' THEN true WHEN c = 'NLDI_NOT_FOUND' THEN false ELSE coalesce(s = 429 OR (s >= 500 AND s < 600), false) OR m IN ('HTTP 503 from service', 'status code: 501', '502, message=''Bad Gateway''', 'request timed out', 'Timeout of nothing', 'Connection reset by peer', 'Too Many Requests', 'status=429') END AS transient FROM x""".replace(repr(_MESSAGES), "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in _MESSAGES) + "]"))
def passing_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), (k % 12 + 1).cast("int"))
    code = F.when(k % 29 == 0, "NLDI_UNAVAILABLE").when(k % 31 == 0, "NLDI_NOT_FOUND")
    return table(spark, sf_dir, "part").select("p_partkey", reliability.transient(message, F.when(k % 4 == 0, 399 + k % 220), code).alias("transient"))


_UNITS = ["mm/day", "MM / d", "kg/m^2/day", "kg/m²/day", "mm day^-1", "mmperday", "m/day", "mm.day-1", ""]


@query(f"""WITH u AS (SELECT p_partkey, [{', '.join(f"'{u}'" for u in _UNITS)}][p_partkey % 9 + 1] AS declared, CASE WHEN p_partkey % 2 = 0 THEN 'mm/d' END AS product FROM part), e AS (SELECT *, coalesce(nullif(declared, ''), product) AS unit FROM u)
SELECT p_partkey, unit, replace(replace(lower(unit), '²', '2'), ' ', '') IN ('mm/day', 'mm/d', 'mmday-1', 'mmd-1', 'mmday^-1', 'mm.day-1', 'kg/m2/day', 'kgm-2day-1', 'kgm-2d-1', 'kg/m^2/day') AS usable FROM e""")
def precipitation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    unit = series.effective_unit(F.element_at(F.array(*map(F.lit, _UNITS)), (k % 9 + 1).cast("int")), F.when(k % 2 == 0, "mm/d"))
    return table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), series.unit_is_mm_per_day(unit).alias("usable"))


@query("""SELECT p_partkey, round(p_retailprice * 86.4 / (p_size * 10), 8) AS mm_day, abs(ln(p_size / 25.0)) <= ln(1.1) AS area_ok, round(0.0663 * power(p_size / 5.0, 0.77) * power(p_size / 400.0, -0.385), 8) AS tc_hr,
lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50 AS in_box, round(2 * 6371008.8 * asin(sqrt(sin(radians(lat + 0.3 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat + 0.3)) * sin(radians(0.7) / 2) ** 2)), 3) AS metres
FROM (SELECT *, -130 + p_partkey % 70 AS lon, 20 + p_partkey % 33 AS lat FROM part)""")
def gauge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    lon, lat = (-130 + k % 70).cast("double"), (20 + k % 33).cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(series.to_mm_per_day(F.col("p_retailprice"), s * 10), 8).alias("mm_day"), series.gauge_area_ok(s, F.lit(25.0)).alias("area_ok"),
        F.round(runoff.kirpich(s / 5.0, s / 400.0), 8).alias("tc_hr"), reliability.conus(lat, lon).alias("in_box"), F.round(network.haversine_m(lon, lat, lon + 0.7, lat + 0.3), 3).alias("metres"),
    )


@query("""WITH c AS (SELECT l_suppkey AS outlet_id, l_linenumber AS rank, ['usgs', 'nldi', 'caller', 'other', 'x', 'y', 'z'][l_linenumber] AS source, max(CASE WHEN l_quantity > 45 THEN l_extendedprice ELSE -1 END) AS area_km2 FROM lineitem GROUP BY 1, 2)
SELECT outlet_id, arg_min(source, rank) FILTER (area_km2 > 0) AS source, arg_min(area_km2, rank) FILTER (area_km2 > 0) AS area_km2 FROM c GROUP BY 1""")
def reported_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("outlet_id"), F.col("l_linenumber").alias("rank")).agg(F.max(F.when(F.col("l_quantity") > 45, F.col("l_extendedprice")).otherwise(-1)).alias("area_km2"))
    return reliability.resolve_reported(c.withColumn("source", F.element_at(F.array(*map(F.lit, ("usgs", "nldi", "caller", "other", "x", "y", "z"))), F.col("rank").cast("int"))))


@query("""WITH w AS (SELECT DISTINCT l_partkey * 2 AS comid FROM lineitem), u AS (SELECT p_partkey AS comid, p_retailprice AS uparea FROM part), l AS (SELECT p_partkey AS comid, p_size / 10.0 AS length_km FROM part WHERE p_partkey % 3 > 0)
SELECT w.comid, uparea, length_km, CASE WHEN uparea IS NULL THEN 'missing' WHEN length_km IS NULL THEN 'no_line' ELSE 'found' END AS status FROM w LEFT JOIN u ON u.comid = w.comid LEFT JOIN l ON l.comid = w.comid""")
def catchment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("comid", F.col("p_partkey"))
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("comid"))
    return network.looked_up(wanted, p.select("comid", F.col("p_retailprice").alias("uparea")), p.where("p_partkey % 3 > 0").select("comid", (F.col("p_size") / 10.0).alias("length_km")))


_FOUND = "c AS (SELECT l_suppkey AS outlet_id, l_orderkey * 10 + l_linenumber AS comid, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS seq, CASE WHEN l_linenumber <> 3 THEN l_quantity * 10 END AS area, 123.0 + l_suppkey % 300 AS expected FROM lineitem)"


@query(f"""WITH {_FOUND}, t AS (SELECT *, abs(area - expected) AS off FROM c WHERE seq < 60)
SELECT outlet_id, coalesce(arg_min(comid, struct_pack(a := off, b := seq)) FILTER (off IS NOT NULL), arg_min(comid, seq)) AS comid, arg_min(area, struct_pack(a := off, b := seq)) FILTER (off IS NOT NULL) AS area_km2, count(*) AS n_candidates,
arg_min(comid, struct_pack(a := off, b := seq)) FILTER (off IS NOT NULL) <> arg_min(comid, seq) AS moved FROM t GROUP BY 1""")
def candidate_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("l_suppkey")
    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")) - 1
    c = table(spark, sf_dir, "lineitem").select(k.alias("outlet_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comid"), seq.alias("seq"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 10).alias("area_km2"), (123.0 + k % 300).alias("expected_km2"))
    return network.best_area_match(c)


@query("""WITH f AS (SELECT p_partkey AS feature_id, (p_partkey * 7 % 400) / 10.0 AS x0, (p_partkey * 11 % 300) / 10.0 AS y0, (p_partkey * 7 % 400) / 10.0 + p_size / 20.0 AS x1, (p_partkey * 11 % 300) / 10.0 + p_size / 25.0 AS y1, p_retailprice AS w FROM part),
v AS (SELECT n_nationkey AS view_id, n_nationkey * 1.5 AS x0, n_regionkey * 5.0 AS y0, n_nationkey * 1.5 + 4 AS x1, n_regionkey * 5.0 + 6 AS y1 FROM nation),
j AS (SELECT view_id, feature_id, row_number() OVER (PARTITION BY view_id ORDER BY w DESC, feature_id) AS rank, count(*) OVER (PARTITION BY view_id) AS n_found FROM v JOIN f ON f.x0 <= v.x1 AND f.x1 >= v.x0 AND f.y0 <= v.y1 AND f.y1 >= v.y0)
SELECT * FROM j WHERE rank <= 25""")
def map_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, r = F.col("p_partkey"), F.col("n_nationkey"), F.col("n_regionkey")
    x, y = (k * 7 % 400) / 10.0, (k * 11 % 300) / 10.0
    f = table(spark, sf_dir, "part").select(k.alias("feature_id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") / 20.0).alias("x1"), (y + F.col("p_size") / 25.0).alias("y1"), F.col("p_retailprice").alias("weight"))
    v = table(spark, sf_dir, "nation").select(n.alias("view_id"), (n * 1.5).alias("x0"), (r * 5.0).alias("y0"), (n * 1.5 + 4).alias("x1"), (r * 5.0 + 6).alias("y1"))
    return network.layer(f, v, 25)


_D8 = [(1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1)]
_MOVES = ", ".join(f"({k}, {r}, {c}, {(abs(r) + abs(c)) ** 0.5!r})" for k, (_, r, c) in enumerate(_D8))
#: Levels by repeating the rule often enough for the small test grid.
_LEVELS = f"""{_GRID.replace('CAST(p_size AS DOUBLE) AS v', 'CAST(p_partkey * 37 % 101 AS DOUBLE) AS v')}, moves(k, dr, dc, dist) AS (VALUES {_MOVES}),
rim AS (SELECT g.r, g.c, g.v, count(n.r) < 8 AS rim FROM grid g CROSS JOIN moves m LEFT JOIN grid n ON n.r = g.r + m.dr AND n.c = g.c + m.dc GROUP BY 1, 2, 3),
lev(i, r, c, v, w, s) AS (SELECT 0, r, c, v, CASE WHEN rim THEN v ELSE 1e300 END, 0 FROM rim
    UNION ALL SELECT any_value(l.i) + 1, l.r, l.c, any_value(l.v), least(struct_pack(w := any_value(l.w), s := any_value(l.s)), min(CASE WHEN l.v > n.w THEN struct_pack(w := l.v, s := 0) ELSE struct_pack(w := n.w, s := n.s + 1) END)).w, least(struct_pack(w := any_value(l.w), s := any_value(l.s)), min(CASE WHEN l.v > n.w THEN struct_pack(w := l.v, s := 0) ELSE struct_pack(w := n.w, s := n.s + 1) END)).s
    FROM lev l JOIN moves m ON true JOIN lev n ON n.r = l.r + m.dr AND n.c = l.c + m.dc WHERE l.i < 60 GROUP BY l.r, l.c),
levels AS (SELECT * FROM lev WHERE i = 60),
near AS (SELECT l.r, l.c, n.r AS tr, n.c AS tc, l.w, l.s, n.w AS nw, n.s AS ns, m.k, m.dist FROM levels l CROSS JOIN moves m JOIN levels n ON n.r = l.r + m.dr AND n.c = l.c + m.dc),
best AS (SELECT r, c, arg_min(struct_pack(tr := tr, tc := tc), struct_pack(a := CASE WHEN nw < w THEN 0 ELSE 1 END, b := CASE WHEN nw < w THEN (nw - w) / dist ELSE 0.0 END, k := k)) AS t FROM near WHERE (nw < w AND s = 0) OR (nw = w AND ns = s - 1) GROUP BY 1, 2),
flow AS (SELECT l.r, l.c, l.v, l.w, l.s, b.t.tr AS tr, b.t.tc AS tc FROM levels l LEFT JOIN best b ON b.r = l.r AND b.c = l.c)"""


def _relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit(0).alias("raster_id"), F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), (k * 37 % 101).cast("double").alias("value"))


@query(f'WITH RECURSIVE {_LEVELS} SELECT 0 AS raster_id, r AS "row", c AS col, v AS value, w AS level, CAST(s AS BIGINT) AS steps, tr AS to_row, tc AS to_col FROM flow')
def flow_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled levels and flow directions; a raster of any size, in tiles of 16 cells here so that several rounds run."""
    levels = routing.filled(_relief(spark, sf_dir), 16)
    return levels.join(network.shuffled(routing.directions(levels)), ["raster_id", "row", "col"])


@query(f"""WITH RECURSIVE {_LEVELS}, dn(r, c, tr, tc) AS (SELECT r, c, r, c FROM flow UNION ALL SELECT d.r, d.c, f.tr, f.tc FROM dn d JOIN flow f ON f.r = d.tr AND f.c = d.tc WHERE f.tr IS NOT NULL), acc AS (SELECT tr AS r, tc AS c, count(*) AS n FROM dn GROUP BY 1, 2),
sl AS (SELECT g.r, g.c, coalesce((e.v - w.v) / 60, (e.v - g.v) / 30, (g.v - w.v) / 30) AS dx, coalesce((s.v - n.v) / 60, (s.v - g.v) / 30, (g.v - n.v) / 30) AS dy FROM grid g
    LEFT JOIN grid e ON e.r = g.r AND e.c = g.c + 1 LEFT JOIN grid w ON w.r = g.r AND w.c = g.c - 1 LEFT JOIN grid s ON s.r = g.r + 1 AND s.c = g.c LEFT JOIN grid n ON n.r = g.r - 1 AND n.c = g.c)
SELECT 0 AS raster_id, a.r AS "row", a.c AS col, a.n AS n_cells, round(ln(a.n * 30 / tan(radians(greatest(degrees(atan(sqrt(dx * dx + dy * dy))), 0.1)))), 8) AS twi FROM acc a JOIN sl ON sl.r = a.r AND sl.c = a.c""")
def wetness_of_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.wetness(_relief(spark, sf_dir), 30.0, 64).select("raster_id", "row", "col", "n_cells", F.round("twi", 8).alias("twi"))


_YEARS = lambda source, a, b: f"yr AS (SELECT basin_id, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS wy, count(*) AS n, sum({a}) AS a, sum({b}) AS b FROM {source} GROUP BY 1, 2), y AS (SELECT *, n / date_diff('day', make_date(wy - 1, 10, 1), make_date(wy, 10, 1)) >= 0.95 - 1e-12 AS whole FROM yr)"
_DRAWS = """ix AS (SELECT *, row_number() OVER (PARTITION BY basin_id ORDER BY wy) - 1 AS k, count(*) OVER (PARTITION BY basin_id) AS m FROM y),
dr AS (SELECT basin_id, rep, i, ((((rep * 7919 + i * 104729 + 12345) * 48271) % 2147483647) * 48271 % 2147483647) // 65536 % m AS k FROM (SELECT DISTINCT basin_id, m FROM ix) u, generate_series(0, 1999) r(rep), generate_series(0, 30) s(i) WHERE i < m),
dn AS (SELECT d.basin_id, d.rep, x.n, x.a, x.b FROM dr d JOIN ix x ON x.basin_id = d.basin_id AND x.k = d.k)"""
_OUT = "SELECT g.basin_id, round(value, 6) AS value, CASE WHEN n_years >= 3 THEN round(lo, 6) END AS ci_low, CASE WHEN n_years >= 3 THEN round(hi, 6) END AS ci_high, CAST(n_days AS BIGINT) AS n_days, n_years, n_partial, n_years < 3 AS refused"
_COUNTS = "g AS (SELECT basin_id, count(*) FILTER (whole) AS n_years, count(*) FILTER (NOT whole) AS n_partial, sum(n) AS n_days FROM y GROUP BY 1)"
_DAILY_REGIONS = DAILY.replace("daily AS", "daily0 AS") + ", daily AS (SELECT basin_id % 2 AS basin_id, d, sum(q) AS q FROM daily0 GROUP BY 1, 2)"
_WET = "p AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS p FROM lineitem GROUP BY 1), pair AS (SELECT a.basin_id, a.d, a.q, p.p FROM daily a JOIN p ON p.d = a.d)"


def _wet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.align(_all_regions(spark, sf_dir), precipitation(spark, sf_dir), 1)


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("basin_id", *(F.round(c, 6).alias(c) for c in ("value", "ci_low", "ci_high")), "n_days", "n_years", "n_partial", "refused", *more)


@query(f"""WITH {_DAILY_REGIONS}, {_WET}, {_YEARS('pair', 'q', 'p')}, {_COUNTS}, {_DRAWS}, r AS (SELECT basin_id, rep, sum(a) / sum(b) AS r FROM dn GROUP BY 1, 2),
e AS (SELECT basin_id, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM r GROUP BY 1), t AS (SELECT basin_id, sum(a) / sum(b) AS value FROM y GROUP BY 1)
{_OUT} FROM g JOIN t ON t.basin_id = g.basin_id JOIN e ON e.basin_id = g.basin_id""")
def runoff_ratio_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(uncertainty.ratio_interval(_wet(spark, sf_dir), "q", "p", "runoff_ratio", min_years=3))


@query(f"""WITH {_DAILY_REGIONS}, {_WET}, {_YEARS('pair', 'q', 'p')}, {_COUNTS}, {_DRAWS}, t AS (SELECT basin_id, rep, sum(a) / sum(n) AS tq, sum(b) / sum(n) AS tp FROM dn GROUP BY 1, 2),
m AS (SELECT d.basin_id, d.rep, ((a / n - tq) / tq) / nullif((b / n - tp) / tp, 0) AS e FROM dn d JOIN t ON t.basin_id = d.basin_id AND t.rep = d.rep), r AS (SELECT basin_id, rep, median(e) AS r FROM m GROUP BY 1, 2),
e AS (SELECT basin_id, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM r GROUP BY 1), t0 AS (SELECT basin_id, sum(a) / sum(n) AS tq, sum(b) / sum(n) AS tp FROM y GROUP BY 1),
v AS (SELECT y.basin_id, median(((a / n - tq) / tq) / nullif((b / n - tp) / tp, 0)) AS value, count(*) FILTER (abs((b / n - tp) / tp) < 0.02) AS n_near_zero FROM y JOIN t0 ON t0.basin_id = y.basin_id GROUP BY 1)
{_OUT}, n_near_zero, n_years < 3 OR n_near_zero > 0 AS degraded FROM g JOIN v ON v.basin_id = g.basin_id JOIN e ON e.basin_id = g.basin_id""")
def elasticity_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(uncertainty.elasticity_interval(_wet(spark, sf_dir), min_years=3), "n_near_zero", "degraded")


#: The filter day by day, in three passes over all long segments at once.
_PASS = lambda name, source, order: f"""{name}i AS (SELECT basin_id, seg, row_number() OVER (PARTITION BY basin_id, seg ORDER BY j {order}) AS t, j, y FROM {source}),
{name}f(basin_id, seg, t, j, y, f) AS (SELECT basin_id, seg, t, j, y, y FROM {name}i WHERE t = 1 UNION ALL SELECT i.basin_id, i.seg, i.t, i.j, i.y, 0.925 * f.f + 0.9625 * (i.y - f.y) FROM {name}f f JOIN {name}i i ON i.basin_id = f.basin_id AND i.seg = f.seg AND i.t = f.t + 1),
{name} AS (SELECT basin_id, seg, j, CASE WHEN f > 0 THEN y - f ELSE y END AS y FROM {name}f)"""  # noqa: E731
_FILTER = f"""{_DAILY_REGIONS}, v AS (SELECT basin_id, d, greatest(q, 0) AS q, d - CAST(row_number() OVER (PARTITION BY basin_id ORDER BY d) AS INTEGER) AS seg FROM daily WHERE q IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY basin_id, seg ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY basin_id, seg) AS n FROM v), l AS (SELECT * FROM s WHERE n > 30),
x AS (SELECT basin_id, seg, i AS j, q AS y FROM l UNION ALL SELECT basin_id, seg, -i, q FROM l WHERE i BETWEEN 1 AND 30 UNION ALL SELECT basin_id, seg, 2 * (n - 1) - i, q FROM l WHERE i BETWEEN n - 31 AND n - 2),
{_PASS('pa', 'x', '')}, {_PASS('pb', 'pa', 'DESC')}, {_PASS('pc', 'pb', '')},
base AS (SELECT l.basin_id, l.d, l.q, greatest(c.y, 0) AS b FROM l JOIN pc c ON c.basin_id = l.basin_id AND c.seg = l.seg AND c.j = l.i)"""
SQL["lh_baseflow"] = f"""WITH RECURSIVE {_FILTER}, days AS (SELECT basin_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY basin_id)
SELECT t.basin_id, t.d, round(b, 2) AS baseflow FROM days t LEFT JOIN base b ON b.basin_id = t.basin_id AND b.d = t.d"""
SQL["baseflow_index"] = f"WITH RECURSIVE {_FILTER} SELECT basin_id, round(greatest(0, least(1, sum(greatest(0, least(b, q))) / sum(q))), 8) AS baseflow_index FROM base GROUP BY 1"


@query(f"""WITH RECURSIVE {_FILTER}, bq AS (SELECT basin_id, d, greatest(0, least(b, q)) AS b, q FROM base), {_YEARS('bq', 'b', 'q')}, {_COUNTS}, {_DRAWS}, r AS (SELECT basin_id, rep, sum(a) / sum(b) AS r FROM dn GROUP BY 1, 2),
e AS (SELECT basin_id, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM r GROUP BY 1), t AS (SELECT basin_id, sum(a) / sum(b) AS value FROM y GROUP BY 1)
{_OUT} FROM g JOIN t ON t.basin_id = g.basin_id JOIN e ON e.basin_id = g.basin_id""")
def baseflow_index_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(uncertainty.baseflow_interval(_all_regions(spark, sf_dir), min_years=3))


@query(f"""WITH {DAILY}, p AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS p FROM lineitem GROUP BY 1)
SELECT 0 AS basin_id, min(d) AS first_day, max(d) AS last_day, round(sum(p), 6) AS total, sha256(string_agg(strftime(d, '%Y-%m-%d') || chr(9) || CAST(p AS VARCHAR) || chr(10), '' ORDER BY d)) AS digest, count(*) AS n_days,
CASE WHEN count(*) < 365 THEN 'too_few_days' WHEN max(p) > 2000 THEN 'max_out_of_range' WHEN avg(p) < 1e-4 THEN 'effectively_zero' WHEN avg(p) > 35 THEN 'mean_out_of_range' END IS NULL AS usable FROM p""")
def precipitation_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = precipitation(spark, sf_dir).where("basin_id = 0").withColumn("p", F.col("p") / 1000)
    return series.provenance(p, "mm/day").select("basin_id", "first_day", "last_day", F.round("total", 6).alias("total"), "digest", "n_days", "usable")


@query(f"""WITH {DAILY}, c AS (SELECT basin_id, d, CASE WHEN day(d) % 3 = 0 THEN 'e' END AS ql, 'A' AS ap FROM daily WHERE basin_id < 3 AND day(d) % 2 = 0)
SELECT x.basin_id, x.d, q, 'm3/s' AS units, CASE WHEN x.basin_id < 3 THEN coalesce(ql, '') END AS qualifier, CASE WHEN x.basin_id < 3 THEN coalesce(ap, '') END AS approval FROM daily x LEFT JOIN c ON c.basin_id = x.basin_id AND c.d = x.d""")
def served_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_flow(spark, sf_dir)
    day = F.dayofmonth("d")
    codes = daily.where((F.col("basin_id") < 3) & (day % 2 == 0)).select("basin_id", "d", F.lit(1).alias("seq"), F.when(day % 3 == 0, "e").alias("qualifier"), F.lit("A").alias("approval"))
    return series.served(daily, codes.union(codes.withColumn("seq", F.lit(2)).withColumn("qualifier", F.lit("later"))))


@query("""SELECT s_suppkey AS basin_id, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 2 END AS expected_days, s_suppkey AS received_days, '1995-01-01' AS "start", CASE WHEN s_suppkey % 2 = 0 THEN '1999-12-31' END AS "end", 'no_leap_dec31' AS calendar FROM supplier""")
def accepted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    fields = {"expected_days": F.when(s % 3 > 0, (s * 2).cast("string")).otherwise(F.lit("many")), "received_days": s.cast("string"), "start": F.lit("1995-01-01"), "end": F.when(s % 2 == 0, "1999-12-31"), "calendar": F.lit("no_leap_dec31"), "unknown": F.lit("x")}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items())))
    return series.accepted_coverage(table(spark, sf_dir, "supplier").select(s.alias("basin_id"), rows.alias("f")).select("basin_id", "f.field", "f.value"))


@query("""SELECT o.o_orderkey AS cokey, l.l_linenumber AS horizon, round(l.l_quantity, 2) AS clay FROM orders o LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) l ON l.l_orderkey = o.o_orderkey""")
def surface_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cokey"), (F.col("l_linenumber") - 2).alias("hzdept_r"), F.col("l_linenumber").alias("horizon"), F.round("l_quantity", 2).alias("clay"))
    return landsoil.component_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cokey")), h).select("cokey", "horizon", "clay")


@query("""SELECT s_suppkey, unnest(['a', 'b']) AS mukey, unnest([CAST(s_suppkey AS VARCHAR), NULL]) AS sand FROM supplier""")
def service_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat(F.lit('{"Table": [["mukey", "sand"], ["a", "'), F.col("s_suppkey").cast("string"), F.lit('"], ["b", null]]}'))
    x = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(landsoil.parse_table(payload)).alias("r"))
    return x.select("s_suppkey", F.col("r")["mukey"].alias("mukey"), F.col("r")["sand"].alias("sand"))


@query(f"""WITH {_GRID} SELECT 0 AS raster_id, r AS "row", c AS col, (c + 0.5 BETWEEN 5 AND 30 AND r + 0.5 BETWEEN 1 AND 3) AND NOT (c + 0.5 BETWEEN 10 AND 20 AND r + 0.5 BETWEEN 1.6 AND 2.8) AS inside FROM grid""")
def cells_in_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _grid(spark, sf_dir).select("raster_id", "row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    rings = [(0, 0, s, x, y) for s, (x, y) in enumerate(((5.0, 1.0), (30.0, 1.0), (30.0, 3.0), (5.0, 3.0)))] + [(0, 1, s, x, y) for s, (x, y) in enumerate(((10.0, 1.6), (20.0, 1.6), (20.0, 2.8), (10.0, 2.8), (10.0, 1.6)))]
    return terrain.inside_ring(cells, spark.createDataFrame(rings, "raster_id int, ring int, seq int, x double, y double")).select("raster_id", "row", "col", "inside")


@query("""SELECT s_suppkey AS basin_id, round(CAST((10 + s_suppkey % 5) * 8 - 4 AS DOUBLE), 6) AS area, round(CAST(2 * (10 + s_suppkey % 5 + 8) + 8 AS DOUBLE), 6) AS perimeter,
round(((10 + s_suppkey % 5) * 8 * (10 + s_suppkey % 5) / 2.0 - 4 * 2) / ((10 + s_suppkey % 5) * 8 - 4), 6) AS cx, round(((10 + s_suppkey % 5) * 8 * 4.0 - 4 * 3) / ((10 + s_suppkey % 5) * 8 - 4), 6) AS cy FROM supplier""")
def polygon_with_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = (10 + F.col("s_suppkey") % 5).cast("double")
    p = lambda ring, hole, seq, x, y: F.struct(F.lit(ring).alias("ring"), F.lit(hole).alias("hole"), F.lit(seq).alias("seq"), x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    points = [p(0, False, 0, F.lit(0), 0), p(0, False, 1, w, 0), p(0, False, 2, w, 8), p(0, False, 3, F.lit(0), 8), p(1, True, 0, F.lit(1), 2), p(1, True, 1, F.lit(3), 2), p(1, True, 2, F.lit(3), 4), p(1, True, 3, F.lit(1), 4)]
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("basin_id"), F.explode(F.array(*points)).alias("p")).select("basin_id", "p.*")
    m = terrain.polygon_measures(v)
    return m.select("basin_id", *(F.round(c, 6).alias(c) for c in ("area", "perimeter", "cx", "cy")))


@query("""WITH x AS (SELECT CAST(p_partkey // 500 AS INTEGER) AS raster_id, p_partkey AS k, CASE WHEN p_size = 7 THEN -9999.0 WHEN p_size <> 9 THEN p_size / 10.0 END AS v FROM part), m AS (SELECT raster_id, median(v) FILTER (v >= -500) AS m, coalesce(max(v) FILTER (v >= -500) - min(v) FILTER (v >= -500) < 1, true) AS flat FROM x GROUP BY 1)
SELECT x.raster_id, k, CASE WHEN v >= -500 THEN v ELSE m END AS value, flat FROM x JOIN m ON m.raster_id = x.raster_id""")
def prepared_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    cells = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 500).cast("int").alias("raster_id"), F.col("p_partkey").alias("k"), F.when(s == 7, -9999.0).when(s != 9, s / 10.0).alias("value"))
    return terrain.fill_dem(cells)


@query(f"""WITH {_MAXIMA}, l AS (SELECT basin_id, log10(value) AS l FROM m WHERE value > 0), a AS (SELECT basin_id, count(*) AS n_years, avg(l) AS mean, stddev_samp(l) AS sd FROM l GROUP BY 1)
SELECT a.basin_id, any_value(n_years) AS n_years, round(any_value(mean), 8) AS mean, round(any_value(sd), 8) AS sd, round(avg((l - mean) ** 3) / any_value(sd) ** 3, 6) AS skew FROM a JOIN l ON l.basin_id = a.basin_id GROUP BY 1""")
def log_pearson_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frequency.log_moments(_maxima(spark, sf_dir))
    return m.select("basin_id", "n_years", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), F.round("skew", 6).alias("skew"))


_SCALED = f"{PAIRED.replace('daily AS', 'daily0 AS').replace('FROM daily a', 'FROM daily0 a').replace('paired AS', 'paired0 AS')}, paired AS (SELECT basin_id, d, q / 1e6 AS q, p / 1e4 AS p FROM paired0), daily AS (SELECT * FROM paired), {report_sql('water', 0.95)}, used AS (SELECT l.* FROM labelled l JOIN judged j ON j.basin_id = l.basin_id AND j.period = l.period AND j.is_complete)"


@query(f"""WITH {_SCALED}, n AS (SELECT basin_id, count(*) AS overlap FROM paired GROUP BY 1), a AS (SELECT basin_id, avg(q) / avg(p) AS rr, count(DISTINCT period) AS y FROM used GROUP BY 1)
SELECT n.basin_id, overlap, coalesce(y, 0) AS n_years, CASE WHEN overlap >= 365 AND rr BETWEEN 1e-3 AND 3 THEN round(rr, 6) END AS runoff_ratio,
CASE WHEN overlap < 365 THEN 'overlap' WHEN y IS NULL THEN 'no_complete_water_year' WHEN rr IS NULL THEN 'not_finite' WHEN NOT rr BETWEEN 1e-3 AND 3 THEN 'outside_range' END AS reason FROM n LEFT JOIN a ON a.basin_id = n.basin_id""")
def water_balance_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all default limits, on flow and rain in plausible units."""
    q = daily_flow(spark, sf_dir).withColumn("q", F.col("q") / 1e6)
    p = precipitation(spark, sf_dir).withColumn("p", F.col("p") / 1e4)
    return signatures.water_balance(series.align(q, p, 1)).withColumn("runoff_ratio", F.round("runoff_ratio", 6))



@query(f"""WITH {DAILY}, k AS (SELECT basin_id, d FROM daily WHERE day(d) = 13 UNION SELECT basin_id, CAST(d + INTERVAL 1 DAY AS DATE) FROM daily WHERE day(d) = 13), w AS (SELECT basin_id, d, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS period FROM daily x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.basin_id = x.basin_id AND k.d = x.d) AND NOT (month(d) = 12 AND day(d) = 31 AND year(d) % 4 = 0)),
c AS (SELECT basin_id, period, CAST(count(DISTINCT d) AS INTEGER) AS n FROM w GROUP BY 1, 2), s AS (SELECT basin_id, CAST(unnest(generate_series(min(period), max(period))) AS INTEGER) AS period FROM c GROUP BY 1), l AS (SELECT basin_id, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS period, count(*) AS lost FROM k GROUP BY 1, 2)
SELECT s.basin_id, s.period, coalesce(n, 0) AS observed_days, CAST(date_diff('day', make_date(s.period - 1, 10, 1), make_date(s.period, 10, 1)) - CASE WHEN (s.period - 1) % 4 = 0 THEN 1 ELSE 0 END - coalesce(lost, 0) AS INTEGER) AS expected_days FROM s LEFT JOIN c ON c.basin_id = s.basin_id AND c.period = s.period LEFT JOIN l ON l.basin_id = s.basin_id AND l.period = s.period""")
def completeness_with_absent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_flow(spark, sf_dir)
    listed = daily.where("day(d) = 13").select("basin_id", "d")
    listed = listed.union(listed.select("basin_id", F.date_add("d", 1)))
    return periods.completeness(daily, "water", calendar="no_leap_dec31", known_absent=listed).select("basin_id", "period", "observed_days", "expected_days")


SQL["runoff_ratio_interval"] = f"""WITH {PAIRED}, {_YEARS('paired', 'q', 'p').replace('y AS (', 'y0 AS (')}, y AS (SELECT * FROM y0 WHERE whole), {_DRAWS}, r AS (SELECT basin_id, rep, sum(a) / sum(b) AS r FROM dn GROUP BY 1, 2),
e AS (SELECT basin_id, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM r GROUP BY 1), t AS (SELECT basin_id, sum(a) / sum(b) AS ratio, count(*) AS n FROM y GROUP BY 1)
SELECT b.basin_id, ratio, CASE WHEN n >= 10 THEN lo END AS ci_low, CASE WHEN n >= 10 THEN hi END AS ci_high, coalesce(n, 0) AS n_years, CASE WHEN coalesce(n, 0) < 10 THEN 'too_few_complete_years' END AS reason FROM (SELECT DISTINCT basin_id FROM paired) b LEFT JOIN t ON t.basin_id = b.basin_id LEFT JOIN e ON e.basin_id = b.basin_id"""


def _signatures_sql(q: str, p: str, share: float) -> str:
    """All signatures from the SQL of each part; flow and rain are scaled by ``q`` and ``p``."""
    scaled = f"{DAILY.replace('daily AS', 'daily0 AS')}, daily AS (SELECT basin_id, d, q * {q} AS q FROM daily0)"
    part = lambda name: SQL[name].replace(DAILY, scaled)
    rain = f"rain AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * {p} AS p FROM lineitem GROUP BY 1)"
    gate = "gate AS (SELECT CASE WHEN count(*) < 365 THEN 'too_few_days' WHEN min(p) < 0 THEN 'negative' WHEN max(p) > 2000 THEN 'max_out_of_range' WHEN avg(p) < 1e-4 THEN 'effectively_zero' WHEN avg(p) > 35 THEN 'mean_out_of_range' END AS gate FROM rain)"
    water = f"""WITH {scaled.replace(', daily AS', ', flow AS')}, {rain}, {gate}, paired0 AS (SELECT f.basin_id, f.d, f.q, r.p, count(*) OVER (PARTITION BY f.basin_id) AS n FROM flow f JOIN rain r ON r.d = f.d), daily AS (SELECT basin_id, d, q, p FROM paired0, gate WHERE n >= 365 AND gate IS NULL), {report_sql('water', share)},
    used AS (SELECT l.* FROM labelled l JOIN judged j ON j.basin_id = l.basin_id AND j.period = l.period AND j.is_complete), n AS (SELECT basin_id, count(*) AS overlap FROM daily GROUP BY 1), a AS (SELECT basin_id, avg(q) / avg(p) AS rr, avg(q) AS tq, avg(p) AS tp, count(DISTINCT period) AS y FROM used GROUP BY 1),
    ye AS (SELECT basin_id, period, avg(q) AS mq, avg(p) AS mp FROM used GROUP BY 1, 2), el AS (SELECT ye.basin_id, count(*) AS k, median(((mq - tq) / tq) / ((mp - tp) / tp)) AS e FROM ye JOIN a ON a.basin_id = ye.basin_id GROUP BY 1),
    w AS (SELECT n.basin_id, coalesce(y, 0) AS y, rr, CASE WHEN y IS NULL THEN 'no_complete_water_year' WHEN rr IS NULL THEN 'not_finite' WHEN NOT rr BETWEEN 1e-3 AND 3 THEN 'outside_range' END AS why, e, k FROM n LEFT JOIN a ON a.basin_id = n.basin_id LEFT JOIN el ON el.basin_id = n.basin_id)
    SELECT b.basin_id, CASE WHEN why IS NULL THEN round(rr, 6) END AS runoff_ratio, y AS water_balance_years, CASE WHEN why IS NULL AND rr IS NOT NULL AND k >= 3 THEN round(e, 4) END AS stream_elas, coalesce('precipitation_' || gate, why, CASE WHEN rr IS NULL THEN 'overlap' END) AS water_balance_reason FROM (SELECT DISTINCT basin_id FROM flow) b CROSS JOIN gate LEFT JOIN w ON w.basin_id = b.basin_id"""
    base = f"WITH RECURSIVE {_FILTER.replace(_DAILY_REGIONS, scaled)} SELECT basin_id, round(greatest(0, least(1, sum(greatest(0, least(b, q))) / sum(q))), 6) AS baseflow_index FROM base GROUP BY 1"
    hfd = f"SELECT basin_id, CASE WHEN count(*) >= 2 THEN round(avg(hfd), 6) END AS hfd_mean, CASE WHEN count(*) >= 2 THEN round(stddev_pop(hfd), 6) END AS half_flow_date_std FROM ({part('half_flow_date').replace('n >= 150', 'n >= 300')}) GROUP BY 1"
    extent = f"WITH {DAILY} SELECT basin_id, min(d) AS first_day, max(d) AS last_day FROM daily GROUP BY 1"
    joined = " ".join(f"LEFT JOIN ({x}) s{i} ON s{i}.basin_id = x.basin_id" for i, x in enumerate((part("flow_stats"), part("event_runs"), hfd, part("fdc_slopes"), base, water)))
    return f"SELECT x.*, s0.* EXCLUDE (basin_id), s1.* EXCLUDE (basin_id), s2.* EXCLUDE (basin_id), s3.* EXCLUDE (basin_id), s4.* EXCLUDE (basin_id), n_days BETWEEN 31 AND 364 AS baseflow_warmup_biased, s5.* EXCLUDE (basin_id) FROM ({extent}) x {joined}"


SQL["signatures_all"] = _signatures_sql("1", "1", 0.95)


@query(_signatures_sql("1e-6", "1e-4", SHARE))
def signatures_of_plausible_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signatures where the gate lets the rain pass; years count from half of their days, as the stand-in series has gaps."""
    q = daily_flow(spark, sf_dir).withColumn("q", F.col("q") * 1e-6)
    p = precipitation(spark, sf_dir).withColumn("p", F.col("p") * 1e-4)
    return rounded_signatures(signatures.extract(q, p, "mm/day", min_fraction=SHARE))


_OLD = lambda name, source, order: f"""{name}i AS (SELECT basin_id, row_number() OVER (PARTITION BY basin_id ORDER BY d {order}) AS t, d, y FROM {source}),
{name}f(basin_id, t, d, y, b) AS (SELECT basin_id, t, d, y, y FROM {name}i WHERE t = 1 UNION ALL SELECT i.basin_id, i.t, i.d, i.y, least(0.925::DOUBLE * f.b + (1 - 0.925::DOUBLE) / 2 * (i.y + f.y), i.y) FROM {name}f f JOIN {name}i i ON i.basin_id = f.basin_id AND i.t = f.t + 1),
{name} AS (SELECT basin_id, d, b AS y FROM {name}f)"""  # noqa: E731


@query(f"WITH RECURSIVE {DAILY}, x AS (SELECT basin_id, d, greatest(q, 0) AS y FROM daily), {_OLD('oa', 'x', '')}, {_OLD('ob', 'oa', 'DESC')}, {_OLD('oc', 'ob', '')} SELECT c.basin_id, c.d, greatest(0, least(c.y, x.y)) AS baseflow FROM oc c JOIN x ON x.basin_id = c.basin_id AND x.d = c.d")
def legacy_baseflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseflow.legacy_clamped(daily_flow(spark, sf_dir))


_HEX = "v AS (SELECT p_partkey AS unit, k AS seq, (p_partkey % 40) * 0.9 + cos(radians(k * 60 + 10)) * 0.5 AS x, (p_partkey // 40) * 0.8 + sin(radians(k * 60 + 10)) * 0.45 AS y FROM part, generate_series(0, 5) g(k))"
_REL = """e AS (SELECT a.unit, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.unit = a.unit AND b.seq = (a.seq + 1) % 6), bx AS (SELECT unit, min(x) - NEAR AS x0, max(x) + NEAR AS x9, min(y) - NEAR AS y0, max(y) + NEAR AS y9 FROM v GROUP BY 1),
pe AS (SELECT p.point_id, e.*, p.x AS px, p.y AS py, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2) AS t0 FROM p JOIN bx ON p.x BETWEEN x0 AND x9 AND p.y BETWEEN y0 AND y9 JOIN e ON e.unit = bx.unit),
r0 AS (SELECT point_id, unit, count(*) FILTER ((y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 = 1 AS inside, min(sqrt((px - x1 - greatest(0, least(1, t0)) * (x2 - x1)) ** 2 + (py - y1 - greatest(0, least(1, t0)) * (y2 - y1)) ** 2)) AS edge FROM pe GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN inside THEN 0 ELSE edge END AS dist FROM r0)"""


def _hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("seq")
    x = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("seq"))
    return x.select(k.alias("unit"), F.lit(0).alias("ring"), "seq", ((k % 40) * 0.9 + F.cos(F.radians(s * 60 + 10)) * 0.5).alias("x"), (F.floor(k / 40) * 0.8 + F.sin(F.radians(s * 60 + 10)) * 0.45).alias("y"))


@query(f"""WITH {_HEX}, p AS (SELECT s_suppkey AS point_id, (s_suppkey * 37 % 3600) / 100.0 AS x, (s_suppkey * 53 % 170) / 100.0 AS y FROM supplier), {_REL.replace('NEAR', '0.05')},
k AS (SELECT r.*, p_retailprice AS u, CASE WHEN inside THEN 0 WHEN dist = 0 THEN 1 ELSE 2 END AS kind FROM r JOIN part ON p_partkey = unit WHERE dist <= 0.05), n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY kind, dist, u DESC, unit) AS n FROM k)
SELECT point_id, unit, ['contains', 'touches', 'nearest'][kind + 1] AS how FROM n WHERE n = 1""")
def locate_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(s.alias("point_id"), ((s * 37 % 3600) / 100.0).alias("x"), ((s * 53 % 170) / 100.0).alias("y"))
    return network.locate_polygons(points, _hexagons(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.col("p_retailprice").alias("uparea")))


@query(f"""WITH v AS (SELECT unit, k AS seq, cx + cos(radians(k * 60)) * w AS x, cy + sin(radians(k * 60)) * w AS y FROM (VALUES ('home', 0.0, 0.0, 3.0), ('border', 0.0, 4.0, 1.6)) b(unit, cx, cy, w), generate_series(0, 5) g(k)),
q AS (SELECT p_partkey AS point_id, CASE WHEN p_partkey % 17 > 0 THEN -4 + (p_partkey * 37 % 800) / 100.0 END AS x, -4 + (p_partkey * 53 % 900) / 100.0 AS y FROM part), p AS (SELECT * FROM q WHERE x IS NOT NULL), {_REL.replace('NEAR', '0.25')},
z AS (SELECT point_id, bool_or(unit = 'home' AND dist <= 0.02) AS home, bool_or(unit = 'border' AND dist <= 0.25) AS border FROM r GROUP BY 1)
SELECT q.point_id, CASE WHEN q.x IS NULL THEN 'undetermined' WHEN NOT coalesce(home, false) THEN 'non_conus' WHEN border THEN 'conus_border_zone' ELSE 'conus' END AS zone FROM q LEFT JOIN z ON z.point_id = q.point_id""")
def outlet_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("seq")
    base = spark.createDataFrame([("home", 0.0, 0.0, 3.0), ("border", 0.0, 4.0, 1.6)], "region string, cx double, cy double, w double").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(5))))
    rings = base.select("region", F.lit(0).alias("ring"), "seq", (F.col("cx") + F.cos(F.radians(s * 60)) * F.col("w")).alias("x"), (F.col("cy") + F.sin(F.radians(s * 60)) * F.col("w")).alias("y"))
    points = table(spark, sf_dir, "part").select(k.alias("point_id"), F.when(k % 17 > 0, -4 + (k * 37 % 800) / 100.0).alias("x"), (-4 + (k * 53 % 900) / 100.0).alias("y"))
    return network.outlet_zone(points, rings)


@query("""WITH c AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS r, CAST(p_partkey % 50 AS INTEGER) AS c, (p_partkey % 50) * 1000.0 AS x, (p_partkey // 50) * 1000.0 AS y, p_retailprice / 1500 AS upa, CASE WHEN p_size > 40 THEN p_size END AS wth FROM part),
o AS (SELECT s_suppkey AS outlet_id, (s_suppkey * 37 % 50) * 1000.0 + 200 AS x, (s_suppkey * 13 % 4) * 1000.0 + 300 AS y, CASE WHEN s_suppkey % 3 > 0 THEN 0.5 + s_suppkey % 40 END AS e FROM supplier), q AS (SELECT *, CASE WHEN e > 0 THEN least(30000, greatest(3000, 1500 * sqrt(e))) ELSE 3000 END AS rad FROM o),
j AS (SELECT q.outlet_id, e, rad, c.r, c.c, upa, sqrt((c.x - q.x) ** 2 + (c.y - q.y) ** 2) AS dist, CASE WHEN upa >= 1 OR wth > 0 THEN 0 WHEN upa > 0 THEN 1 ELSE 2 END AS kind FROM q JOIN c ON abs(c.x - q.x) <= rad AND abs(c.y - q.y) <= rad),
k AS (SELECT *, min(kind) OVER (PARTITION BY outlet_id) AS bk FROM j WHERE dist <= rad), m AS (SELECT *, max(ln(1 + upa)) OVER (PARTITION BY outlet_id) AS mx FROM k WHERE kind = bk),
s AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY CASE WHEN e > 0 THEN abs(upa - e) / greatest(e, 1) + 0.35 * dist / rad ELSE dist / rad - 0.2 * ln(1 + upa) / greatest(mx, 1) END, r, c) AS n FROM m)
SELECT outlet_id, r AS "row", c AS col, round(dist, 4) AS dist, upa, CASE WHEN e > 0 THEN 'area_targeted' ELSE 'nearest_merit_stream' END || CASE WHEN dist > 5000 THEN '_far' ELSE '' END AS quality FROM s WHERE n = 1""")
def snap_with_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams by width or area, each outlet with the radius of its expected area."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    cells = table(spark, sf_dir, "part").select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), ((k % 50) * 1000.0).alias("x"), (F.floor(k / 50) * 1000.0).alias("y"), (F.col("p_retailprice") / 1500).alias("upa"), F.when(F.col("p_size") > 40, F.col("p_size")).alias("wth"))
    outlets = table(spark, sf_dir, "supplier").select(s.alias("outlet_id"), ((s * 37 % 50) * 1000.0 + 200).alias("x"), ((s * 13 % 4) * 1000.0 + 300).alias("y"), F.when(s % 3 > 0, 0.5 + s % 40).alias("expected_km2"))
    return network.snap(outlets, cells, None, expected=True).withColumn("dist", F.round("dist", 4))


@query(f"""WITH {_CN_SQL}, x AS (SELECT c.*, p.p_size AS s, CASE WHEN c.raster_id % 2 = 0 AND c.p_partkey % 7 > 0 THEN ['A', 'B/D', 'C', 'D'][c.g] END AS hydgrp FROM cells c JOIN part p ON p.p_partkey = c.p_partkey),
h AS (SELECT *, max(CASE WHEN hydgrp IS NOT NULL THEN 1 END) OVER (PARTITION BY raster_id) AS has FROM x), sand AS (SELECT *, s * 1.5 AS sand, 15.0 AS clay, 85 - s * 1.5 AS silt FROM h),
t AS (SELECT *, CASE WHEN has = 1 THEN CASE WHEN hydgrp = 'B/D' THEN 2 WHEN hydgrp IS NOT NULL THEN g END WHEN (sand BETWEEN 50 AND 70 AND clay < 20) OR (silt > 50 AND clay < 27) THEN 2 WHEN sand > 70 AND clay < 10 THEN 1 WHEN clay >= 20 AND clay < 40 THEN 3 ELSE 4 END AS dg FROM sand),
u AS (SELECT *, CASE WHEN hydgrp = 'B/D' THEN 4 ELSE dg END AS ug FROM t), v AS (SELECT u.*, a.cn, b.cn AS cu FROM u LEFT JOIN cn_table a ON a.class = u.class AND a.g = u.dg LEFT JOIN cn_table b ON b.class = u.class AND b.g = u.ug)
SELECT raster_id, CASE WHEN max(has) = 1 THEN 'recorded' ELSE 'texture_thresholds' END AS method, max(has) IS NULL AS inferred, CASE WHEN max(has) = 1 THEN round(avg(CASE WHEN dg IS NULL THEN 1.0 ELSE 0 END), 8) END AS missing_fraction, count(*) FILTER (inside AND cn IS NOT NULL) AS cells_basin,
round(avg(cn) FILTER (inside), 6) AS cn_mean_basin, round(avg(cu) FILTER (inside), 6) AS cn_mean_undrained, concat_ws(',', CASE WHEN count(*) FILTER (inside AND cn IS NOT NULL) = 0 THEN 'basin_cn_stats_empty' END, CASE WHEN max(has) IS NULL THEN 'hsg_inferred_from_texture' END) AS flags FROM v GROUP BY 1""")
def curve_number_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids from recorded groups or from texture, and where they come from."""
    k, s = F.col("p_partkey"), F.col("p_size")
    cells = _cells(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    names = F.element_at(F.array(*map(F.lit, ("A", "B/D", "C", "D"))), F.col("group"))
    cells = cells.withColumn("hydgrp", F.when((F.col("raster_id") % 2 == 0) & (k % 7 > 0), names)).withColumn("sand", s * 1.5).withColumn("clay", F.lit(15.0)).withColumn("silt", 85 - s * 1.5).drop("group", "p_size")
    r = landsoil.soil_record(landsoil.built_grid(cells))
    return r.select("raster_id", "method", "inferred", F.round("missing_fraction", 8).alias("missing_fraction"), "cells_basin", F.round("cn_mean_basin", 6).alias("cn_mean_basin"), F.round("cn_mean_undrained", 6).alias("cn_mean_undrained"), "flags")
