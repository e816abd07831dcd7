"""Queries over the test tables, each with the same result in SQL.

Stand-ins: a basin is a region, its daily flow is what its customers ordered that day; precipitation is the quantity
shipped that day; networks, rasters, soils and candidates come from parts, suppliers and line items.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import special
from tarnflow.operators import baseflow, compare, drought, frequency, landsoil, network, periods, reliability, runoff, series, signatures, terrain, uncertainty
from tarnflow.streaming import daily as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(basin_id, d, q)``; nations and customers are broadcast only if Spark finds them small."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    money = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return j.groupBy(F.col("n_regionkey").alias("basin_id"), F.to_date("o_orderdate").alias("d")).agg(money.alias("q"))


DAILY = """daily AS (
    SELECT n_regionkey AS basin_id, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS q
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
DENSE = DAILY + """, dense AS (
    SELECT s.basin_id, s.d, x.q FROM (SELECT basin_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY basin_id) s
    LEFT JOIN daily x ON x.basin_id = s.basin_id AND x.d = s.d)"""


def precipitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(basin_id, d, p)``: the same in all five basins."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("p"))
    return p.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("basin_id"), "d", "p")


PAIRED = DAILY + """, paired AS (
    SELECT a.basin_id, a.d, a.q, p.p FROM daily a JOIN (SELECT CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS p FROM lineitem GROUP BY 1) p ON a.d = p.d)"""


def report_sql(freq: str, share: float) -> str:
    """Completeness of the ``daily`` table in SQL."""
    label = {"water": "year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END", "climatic": "year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END", "calendar": "year(d)", "custom": "year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END"}[freq]
    first = {"water": "make_date(period - 1, 10, 1)", "climatic": "make_date(period, 4, 1)", "calendar": "make_date(period, 1, 1)", "custom": "make_date(period, 7, 1)"}[freq]
    return f"""labelled AS (SELECT *, CAST({label} AS INTEGER) AS period FROM daily),
    counted AS (SELECT basin_id, period, count(DISTINCT d) AS n FROM labelled GROUP BY 1, 2),
    spine AS (SELECT basin_id, CAST(unnest(generate_series(min(period), max(period))) AS INTEGER) AS period FROM counted GROUP BY 1),
    found AS (SELECT s.basin_id, s.period, CAST(coalesce(n, 0) AS INTEGER) AS observed_days FROM spine s LEFT JOIN counted c ON c.basin_id = s.basin_id AND c.period = s.period),
    report AS (SELECT basin_id, period, observed_days, CAST(date_diff('day', {first}, CAST({first} + INTERVAL 1 YEAR AS DATE)) AS INTEGER) AS expected_days FROM found),
    judged AS (SELECT *, observed_days / expected_days AS fraction, observed_days / expected_days >= {share} - 1e-12 AS is_complete FROM report)"""


def completeness_query(freq: str, share: float, custom: int | None = None):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return periods.completeness(daily_flow(spark, sf_dir), freq, share, custom).withColumn("fraction", F.round("fraction", 6))

    f.__name__ = f"period_completeness_{freq}"
    query(f"WITH {DAILY}, {report_sql(freq, share)} SELECT basin_id, period, observed_days, expected_days, round(fraction, 6) AS fraction, is_complete FROM judged")(f)


for _freq, _share, _custom in (("water", 0.95, None), ("climatic", 0.95, None), ("calendar", 0.7, None), ("custom", 0.7, 7)):
    completeness_query(_freq, _share, _custom)

#: Share of days that a year of the stand-in series needs; regions have orders on about 70 % of days at the smallest sizes.
SHARE = 0.5


@query(f"""WITH {DAILY}, m AS (SELECT basin_id, strftime(d, '%Y-%m') AS month, count(DISTINCT d) AS n, sum(q) AS t FROM daily GROUP BY 1, 2),
spine AS (SELECT basin_id, strftime(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM daily GROUP BY 1)
SELECT s.basin_id, s.month, CASE WHEN n / day(last_day(CAST(s.month || '-01' AS DATE))) >= 0.6 - 1e-12 THEN round(t, 2) END AS total FROM spine s LEFT JOIN m ON m.basin_id = s.basin_id AND m.month = s.month""")
def monthly_totals_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drought.monthly_totals(daily_flow(spark, sf_dir), 0.6).withColumn("total", F.round("total", 2))


@query(f"WITH {DAILY}, {report_sql('water', SHARE)} SELECT l.basin_id, l.period, max(l.q) AS max_q FROM labelled l JOIN judged j ON j.basin_id = l.basin_id AND j.period = l.period AND j.is_complete GROUP BY 1, 2")
def annual_max_wy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.annual_maxima(daily_flow(spark, sf_dir), "water", SHARE)


@query(f"""WITH {DENSE}, {report_sql('climatic', 0.3)},
rolled AS (SELECT basin_id, d, CASE WHEN count(q) OVER w = 3 THEN avg(q) OVER w END AS m FROM dense WINDOW w AS (PARTITION BY basin_id ORDER BY d ROWS 2 PRECEDING)),
got AS (SELECT basin_id, CAST(year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END AS INTEGER) AS period, count(m) AS n, min(m) AS min_q FROM rolled GROUP BY 1, 2)
SELECT g.basin_id, g.period, round(min_q, 4) AS min_q FROM got g JOIN judged j ON j.basin_id = g.basin_id AND j.period = g.period AND is_complete WHERE n / expected_days >= 0.1 - 1e-12""")
def min3_climatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.annual_minima(daily_flow(spark, sf_dir), 3, "climatic", 0.3, 0.1).withColumn("min_q", F.round("min_q", 4))


@query(f"""WITH {DAILY} SELECT basin_id, count(q) AS n_days, CASE WHEN count(q) >= 365 THEN round(avg(q), 4) END AS q_mean, CASE WHEN count(q) >= 365 THEN round(stddev_pop(q), 4) END AS q_std,
CASE WHEN count(q) >= 365 THEN round(quantile_cont(q, 0.05), 4) END AS q5, CASE WHEN count(q) >= 365 THEN round(median(q), 4) END AS q_median, CASE WHEN count(q) >= 365 THEN round(quantile_cont(q, 0.95), 4) END AS q95 FROM daily GROUP BY 1""")
def flow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signatures.flow_stats(daily_flow(spark, sf_dir))
    return s.select("basin_id", "n_days", *(F.round(c, 4).alias(c) for c in ("q_mean", "q_std", "q5", "q_median", "q95")))


@query(f"""WITH {DAILY}, p AS (SELECT basin_id, unnest([5, 10, 25, 50, 75, 90, 95]) AS k, unnest(quantile_cont(q, [0.95, 0.9, 0.75, 0.5, 0.25, 0.1, 0.05])) AS v FROM daily GROUP BY 1)
SELECT basin_id, CAST(k AS INTEGER) AS exceedance_pct, round(v, 5) AS flow FROM p""")
def fdc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.fdc_points(daily_flow(spark, sf_dir)).withColumn("flow", F.round("flow", 5))


@query(f"WITH {DAILY} SELECT basin_id, d, q, round(row_number() OVER (PARTITION BY basin_id ORDER BY q DESC, d) / (count(*) OVER (PARTITION BY basin_id) + 1), 8) AS exceedance FROM daily WHERE q >= 0")
def fdc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.fdc_curve(daily_flow(spark, sf_dir)).withColumn("exceedance", F.round("exceedance", 8))


@query(f"""WITH {DAILY} SELECT basin_id, CASE WHEN count(q) >= 100 THEN round((quantile_cont(q, 0.66) - quantile_cont(q, 0.33)) / (avg(q) * 0.33), 6) END AS slope_fdc,
CASE WHEN count(q) FILTER (q > 0) >= 100 THEN round((ln(quantile_cont(q, 0.67) FILTER (q > 0)) - ln(quantile_cont(q, 0.34) FILTER (q > 0))) / 0.33, 6) END AS slope_fdc_sawicz2011 FROM daily GROUP BY 1""")
def fdc_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signatures.fdc_slopes(daily_flow(spark, sf_dir))
    return s.select("basin_id", F.round("slope_fdc", 6).alias("slope_fdc"), F.round("slope_fdc_sawicz2011", 6).alias("slope_fdc_sawicz2011"))


@query(f"""WITH {DAILY}, t AS (SELECT basin_id, count(q) AS n, avg(q) AS mean, median(q) AS med, stddev_pop(q) AS sd, count(*) FILTER (q <= 0) AS z FROM daily GROUP BY 1),
e AS (SELECT d.basin_id, d.d, unnest(['high', 'low']) AS kind, unnest([d.q > 9 * t.med, d.q <= 0.2 * t.mean]) AS flag FROM daily d JOIN t ON t.basin_id = d.basin_id),
g AS (SELECT basin_id, kind, d - CAST(row_number() OVER (PARTITION BY basin_id, kind ORDER BY d) AS INTEGER) AS island FROM e WHERE flag),
r AS (SELECT basin_id, kind, island, count(*) AS k FROM g GROUP BY 1, 2, 3),
a AS (SELECT basin_id, sum(k) FILTER (kind = 'high') AS hs, avg(k) FILTER (kind = 'high') AS ha, sum(k) FILTER (kind = 'low') AS ls, avg(k) FILTER (kind = 'low') AS la FROM r GROUP BY 1)
SELECT t.basin_id, round(coalesce(hs, 0) / n * 365.25, 6) AS high_q_freq, round(ha, 6) AS high_q_dur, round(coalesce(ls, 0) / n * 365.25, 6) AS low_q_freq, round(la, 6) AS low_q_dur, round(z / n, 6) AS zero_q_freq, round(sd / mean, 6) AS flow_variability
FROM t LEFT JOIN a ON a.basin_id = t.basin_id""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signatures.event_stats(daily_flow(spark, sf_dir))
    return s.select("basin_id", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@query(f"""WITH {DAILY}, w AS (SELECT *, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS water_year FROM daily),
c AS (SELECT basin_id, water_year, d, sum(q) OVER (PARTITION BY basin_id, water_year ORDER BY d ROWS UNBOUNDED PRECEDING) AS c, sum(q) OVER (PARTITION BY basin_id, water_year) AS t, count(*) OVER (PARTITION BY basin_id, water_year) AS n FROM w)
SELECT basin_id, water_year, CAST(date_diff('day', make_date(water_year - 1, 10, 1), min(d)) + 1 AS INTEGER) AS hfd FROM c WHERE n >= 150 AND c >= 0.5 * t GROUP BY 1, 2""")
def half_flow_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.half_flow_dates(daily_flow(spark, sf_dir), 150)


@query(f"""WITH {DENSE}, gaps AS (SELECT basin_id, d, d - CAST(row_number() OVER (PARTITION BY basin_id ORDER BY d) AS INTEGER) AS g FROM dense WHERE q IS NULL)
SELECT basin_id, min(d) AS "start", max(d) AS "end", count(*) AS n_days, 'absent_in_response' AS reason FROM gaps GROUP BY basin_id, g""")
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.missing_ranges(daily_flow(spark, sf_dir))


@query(f"""WITH {DENSE}, r AS (SELECT basin_id, d, CASE WHEN d BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' THEN 'outage' WHEN d BETWEEN DATE '1996-03-01' AND DATE '1997-12-31' THEN 'ice' ELSE 'absent_in_response' END AS reason FROM dense WHERE q IS NULL),
f AS (SELECT *, CASE WHEN lag(d) OVER w IS NULL OR d - lag(d) OVER w > 1 OR lag(reason) OVER w <> reason THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY basin_id ORDER BY d)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY basin_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT basin_id, min(d) AS "start", max(d) AS "end", count(*) AS n_days, reason FROM g GROUP BY basin_id, g, reason""")
def missing_ranges_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_flow(spark, sf_dir)
    rows = [(b, s, e, r, k) for b in range(5) for k, (s, e, r) in enumerate((("1996-01-01", "1996-06-30", "outage"), ("1996-03-01", "1997-12-31", "ice")))]
    reasons = spark.createDataFrame(rows, "basin_id int, start string, end string, reason string, priority int")
    reasons = reasons.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end"))
    return series.missing_ranges(daily, reasons)


@query(f"""WITH {PAIRED}, p AS (SELECT basin_id, p FROM (SELECT CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS p FROM lineitem GROUP BY 1), generate_series(0, 4) g(basin_id)),
f AS (SELECT CAST(basin_id AS INTEGER) AS basin_id, count(p) AS n, min(p) AS lo, max(p) AS hi, avg(p) AS m FROM p GROUP BY 1)
SELECT basin_id, n AS n_days, CASE WHEN n < 365 THEN 'too_few_days' WHEN lo < 0 THEN 'negative' WHEN hi > 2000 THEN 'max_out_of_range' WHEN m < 1e-4 THEN 'effectively_zero' WHEN m > 35 THEN 'mean_out_of_range' END AS reason FROM f""")
def precip_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.precipitation_problem(precipitation(spark, sf_dir), "mm/day")


_USED = f"{PAIRED.replace('daily AS', 'daily0 AS').replace('FROM daily a', 'FROM daily0 a')}, daily AS (SELECT * FROM paired), {report_sql('water', SHARE)}, used AS (SELECT l.* FROM labelled l JOIN judged j ON j.basin_id = l.basin_id AND j.period = l.period AND j.is_complete)"


@query(f"""WITH {_USED}, n AS (SELECT basin_id, count(*) AS overlap FROM paired GROUP BY 1), a AS (SELECT basin_id, avg(q) / avg(p) AS rr, count(DISTINCT period) AS y FROM used GROUP BY 1)
SELECT n.basin_id, overlap, coalesce(y, 0) AS n_years, CASE WHEN overlap >= 365 AND rr BETWEEN 1e-3 AND 1e9 THEN round(rr, 6) END AS runoff_ratio,
CASE WHEN overlap < 365 THEN 'overlap' WHEN y IS NULL THEN 'no_complete_water_year' WHEN rr IS NULL THEN 'not_finite' WHEN NOT rr BETWEEN 1e-3 AND 1e9 THEN 'outside_range' END AS reason FROM n LEFT JOIN a ON a.basin_id = n.basin_id""")
def water_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = series.align(daily_flow(spark, sf_dir), precipitation(spark, sf_dir), 1)
    return signatures.water_balance(paired, high=1e9, min_fraction=SHARE).withColumn("runoff_ratio", F.round("runoff_ratio", 6))


@query(f"""WITH {_USED}, y AS (SELECT basin_id, period, avg(q) AS mq, avg(p) AS mp FROM used GROUP BY 1, 2), t AS (SELECT basin_id, avg(q) AS tq, avg(p) AS tp FROM used GROUP BY 1)
SELECT y.basin_id, count(*) AS n_years, CASE WHEN count(*) >= 3 THEN round(median(((mq - tq) / tq) / ((mp - tp) / tp)), 4) END AS stream_elas FROM y JOIN t ON t.basin_id = y.basin_id GROUP BY 1""")
def elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = series.align(daily_flow(spark, sf_dir), precipitation(spark, sf_dir), 1)
    return signatures.elasticity(paired, min_fraction=SHARE).withColumn("stream_elas", F.round("stream_elas", 4))


def _maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.annual_maxima(daily_flow(spark, sf_dir), "water", SHARE).withColumnRenamed("max_q", "value")


_MAXIMA = f"{DAILY}, {report_sql('water', SHARE)}, m AS (SELECT l.basin_id, l.period, max(l.q) AS value FROM labelled l JOIN judged j ON j.basin_id = l.basin_id AND j.period = l.period AND j.is_complete GROUP BY 1, 2)"


@query(f"""WITH {_MAXIMA}, f AS (SELECT basin_id, count(*) AS n_years, avg(value) AS a, stddev_samp(value) * sqrt(6.0) / pi() AS s FROM m GROUP BY 1 HAVING count(*) >= 5),
t AS (SELECT *, unnest([2, 5, 10, 25, 50, 100, 200, 500]) AS k FROM f)
SELECT basin_id, n_years, CAST(k AS INTEGER) AS return_period, round(a - {special.EULER} * s - s * ln(-ln(1 - 1 / k)), 2) AS level FROM t""")
def flood_gumbel_mom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.gumbel_moments(_maxima(spark, sf_dir)).select("basin_id", "n_years", "return_period", F.round("level", 2).alias("level"))


@query(f"""WITH {_MAXIMA}, r AS (SELECT basin_id, value, row_number() OVER (PARTITION BY basin_id ORDER BY value DESC, period) / (count(*) OVER (PARTITION BY basin_id) + 1) AS p FROM m)
SELECT basin_id, round(value, 4) AS value, round(p, 6) AS exceedance_prob, round(1 / p, 3) AS return_period FROM r""")
def plotting_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.plotting_positions(_maxima(spark, sf_dir))


#: Which year each draw takes, by the fixed rule, of ``u (basin_id, m)`` basins of ``m`` years.
_DRAW = "((((rep * 7919 + i * 104729 + 12345) * 48271) % 2147483647) * 48271 % 2147483647) // 65536 % m"


@query(f"""WITH RECURSIVE {_MAXIMA}, u AS (SELECT basin_id, list(value ORDER BY period) AS xs, count(*) AS m FROM m GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT basin_id, m, -1 AS rep, xs FROM u UNION ALL SELECT basin_id, m, rep, list(xs[{_DRAW} + 1] ORDER BY i) FROM u CROSS JOIN generate_series(0, 499) r(rep) CROSS JOIN generate_series(0, 99) q(i) WHERE i < m GROUP BY basin_id, m, rep),
y AS (SELECT basin_id, m, rep, list_min(xs) AS low, list_avg(xs) - list_min(xs) AS mean, list_transform(xs, lambda x: x - list_min(xs)) AS y, list_max(xs) > list_min(xs) AS varied, list_stddev_samp(xs) * sqrt(6.0) / pi() AS s0 FROM s),
n(k, basin_id, m, rep, low, mean, y, varied, s) AS (SELECT 0, basin_id, m, rep, low, mean, y, varied, CASE WHEN varied THEN s0 ELSE 1 END FROM y UNION ALL
    SELECT k + 1, basin_id, m, rep, low, mean, y, varied, CASE WHEN NOT varied THEN 1 WHEN t > 0 THEN t ELSE s / 2 END FROM (SELECT *, s + (mean - a / w - s) / ((b / w - (a / w) * (a / w)) / (s * s) + 1) AS t
        FROM (SELECT *, list_sum(list_transform(y, lambda v: exp(-v / s))) AS w, list_sum(list_transform(y, lambda v: v * exp(-v / s))) AS a, list_sum(list_transform(y, lambda v: v * v * exp(-v / s))) AS b FROM n WHERE k < 40))),
f AS (SELECT basin_id, m, rep, CASE WHEN varied THEN s ELSE 0 END AS scale, low - CASE WHEN varied THEN s ELSE 0 END * ln(list_avg(list_transform(y, lambda v: exp(-v / s)))) AS loc FROM n WHERE k = 40),
l AS (SELECT basin_id, m, rep, t, loc - scale * ln(-ln(1 - 1 / t)) AS level FROM f CROSS JOIN (VALUES (2), (5), (10), (25), (50), (100), (200), (500)) p(t))
SELECT basin_id, m AS n_years, CAST(t AS INTEGER) AS return_period, round(max(level) FILTER (rep = -1), 3) AS level, round(quantile_cont(level, 0.05) FILTER (rep >= 0), 3) AS ci_low, round(quantile_cont(level, 0.95) FILTER (rep >= 0), 3) AS ci_high FROM l GROUP BY 1, 2, 3""")
def flood_frequency_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frequency.flood_frequency(_maxima(spark, sf_dir), "gumbel", "mle")
    return f.select("basin_id", "n_years", "return_period", *(F.round(c, 3).alias(c) for c in ("level", "ci_low", "ci_high")))


@query()
def flood_frequency_lp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.flood_frequency(_maxima(spark, sf_dir), "lp3")


@query()
def seven_q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.seven_q10(signatures.annual_minima(daily_flow(spark, sf_dir), 3, "climatic", 0.3, 0.1), min_years=3)


_ROLLED = f"""{DAILY}, m AS (SELECT basin_id, strftime(d, '%Y-%m') AS month, count(DISTINCT d) AS n, sum(q) AS t FROM daily GROUP BY 1, 2),
spine AS (SELECT basin_id, strftime(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM daily GROUP BY 1),
tot AS (SELECT s.basin_id, s.month, CASE WHEN n / day(last_day(CAST(s.month || '-01' AS DATE))) >= 0.6 - 1e-12 THEN t END AS total FROM spine s LEFT JOIN m ON m.basin_id = s.basin_id AND m.month = s.month),
rolled AS (SELECT basin_id, month, CASE WHEN count(total) OVER w = 3 THEN sum(total) OVER w END AS rolled FROM tot WINDOW w AS (PARTITION BY basin_id ORDER BY month ROWS 2 PRECEDING))"""


@query(f"""WITH {_ROLLED} SELECT basin_id, month, round((row_number() OVER (PARTITION BY basin_id, substr(month, 6, 2) ORDER BY rolled, month) - 0.44) / (count(*) OVER (PARTITION BY basin_id, substr(month, 6, 2)) + 0.12), 6) AS p FROM rolled WHERE rolled IS NOT NULL""")
def gringorten_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = drought.monthly_totals(daily_flow(spark, sf_dir), 0.6)
    return drought.gringorten(drought.rolling(monthly, 3)).withColumn("p", F.round("p", 6))


@query()
def spi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drought.standardise(drought.monthly_totals(daily_flow(spark, sf_dir), 0.6), 3, "gamma")


@query()
def spei(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = daily_flow(spark, sf_dir)
    pet = precipitation(spark, sf_dir).select("basin_id", "d", (F.col("p") * 400).alias("q"))
    both = flow.alias("a").join(pet.alias("b"), ["basin_id", "d"]).select("basin_id", "d", (F.col("a.q") - F.col("b.q")).alias("q"))
    return drought.standardise(drought.monthly_totals(both, 0.6), 3, "loglogistic")


@query(f"""WITH {DAILY}, x AS (SELECT *, row_number() OVER (PARTITION BY basin_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY basin_id) // 5 AS nb FROM daily),
lows AS (SELECT basin_id, i // 5 AS b, min(q) AS q, arg_min(i, struct_pack(q := q, i := i)) AS i FROM x WHERE i // 5 < nb GROUP BY 1, 2),
l2 AS (SELECT *, lag(q) OVER w AS a, lead(q) OVER w AS z FROM lows WINDOW w AS (PARTITION BY basin_id ORDER BY b)),
turn AS (SELECT basin_id, i, q AS tq FROM l2 WHERE a IS NULL OR z IS NULL OR (0.9 * q < a AND 0.9 * q < z)),
y AS (SELECT x.*, t.tq, CASE WHEN t.tq IS NOT NULL THEN x.i END AS ti FROM x LEFT JOIN turn t ON t.basin_id = x.basin_id AND t.i = x.i),
s AS (SELECT *, last_value(ti IGNORE NULLS) OVER a AS li, last_value(tq IGNORE NULLS) OVER a AS lq, first_value(ti IGNORE NULLS) OVER z AS hi, first_value(tq IGNORE NULLS) OVER z AS hq FROM y
    WINDOW a AS (PARTITION BY basin_id ORDER BY i ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY basin_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT basin_id, d, round(greatest(0, least(q, CASE WHEN li IS NULL THEN hq WHEN hi IS NULL OR hi = li THEN lq ELSE lq + (hq - lq) * (i - li) / (hi - li) END)), 8) AS baseflow FROM s""")
def ukih_baseflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseflow.ukih(daily_flow(spark, sf_dir)).select("basin_id", "d", F.round("baseflow", 8).alias("baseflow"))


def _all_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series with few gaps: orders of the even regions, and of the odd ones."""
    return daily_flow(spark, sf_dir).groupBy((F.col("basin_id") % 2).alias("basin_id"), "d").agg(F.sum("q").alias("q"))


@query()
def lh_baseflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseflow.lyne_hollick(_all_regions(spark, sf_dir)).select("basin_id", "d", F.round("baseflow", 2).alias("baseflow"))


@query()
def baseflow_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseflow.baseflow_index(_all_regions(spark, sf_dir)).withColumn("baseflow_index", F.round("baseflow_index", 8))


def rounded_signatures(s: DataFrame) -> DataFrame:
    digits = dict.fromkeys(("q_mean", "q_std", "q5", "q_median", "q95", "stream_elas"), 4)
    return s.select(*(F.round(c, digits.get(c, 6)).alias(c) if kind == "double" else F.col(c) for c, kind in s.dtypes))


@query()
def signatures_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_signatures(signatures.extract(daily_flow(spark, sf_dir), precipitation(spark, sf_dir), "mm/day"))


@query(f"""WITH {DAILY}, f AS (SELECT *, CASE WHEN day(d) % 5 = 0 THEN 'e' WHEN day(d) % 7 = 0 THEN 'e,Ice' WHEN day(d) % 11 = 0 THEN 'Bkw' ELSE '' END AS ql, CASE WHEN year(d) >= 2000 THEN 'P' ELSE 'A' END AS ap FROM daily),
t AS (SELECT basin_id, avg(q) AS mean, median(q) AS med, quantile_cont(q, 0.1) AS p10, quantile_cont(q, 0.33) AS p33, quantile_cont(q, 0.66) AS p66, quantile_cont(q, 0.9) AS p90 FROM daily GROUP BY 1),
x AS (SELECT f.*, unnest(['all_days', 'mid_range', 'low_tail', 'high_tail', 'low_flow_events', 'high_flow_events', 'zero_days', 'baseflow_days']) AS day_set,
    unnest([true, q >= p33 AND q <= p66, q <= p10, q >= p90, q <= 0.2 * mean, q > 9 * med, q <= 0, q <= med]) AS flag FROM f JOIN t ON t.basin_id = f.basin_id)
SELECT basin_id, day_set, count(*) AS n_days, count(*) FILTER (ql LIKE 'e%') AS n_estimated, count(*) FILTER (ql IN ('e,Ice', 'Bkw')) AS n_other, count(*) FILTER (ql <> '') AS n_any, count(*) FILTER (ap = 'P') AS n_provisional FROM x WHERE flag GROUP BY 1, 2""")
def qualifier_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("d")
    marks = F.when(day % 5 == 0, "e").when(day % 7 == 0, "e,Ice").when(day % 11 == 0, "Bkw").otherwise("")
    return uncertainty.exposure(daily_flow(spark, sf_dir).withColumn("qualifiers", marks).withColumn("approval", F.when(F.year("d") >= 2000, "P").otherwise("A")))


@query(f"""WITH {DAILY.replace("daily AS", "daily0 AS")}, daily AS (SELECT basin_id % 2 AS basin_id, d, sum(q) AS q FROM daily0 GROUP BY 1, 2), x AS (SELECT basin_id, q, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS wy FROM daily),
y AS (SELECT basin_id, wy, row_number() OVER (PARTITION BY basin_id ORDER BY wy) - 1 AS k, count(*) >= 0.95 * date_diff('day', make_date(wy - 1, 10, 1), make_date(wy, 10, 1)) AS whole FROM x GROUP BY 1, 2), u AS (SELECT basin_id, count(*) AS m, count(*) FILTER (whole) AS n_years FROM y GROUP BY 1),
t AS (SELECT basin_id, -1 AS rep, wy, 1 AS times FROM y UNION ALL SELECT d.basin_id, rep, wy, count(*) FROM (SELECT basin_id, rep, {_DRAW} AS k FROM u CROSS JOIN generate_series(0, 1999) r(rep) CROSS JOIN generate_series(0, 99) q(i) WHERE i < m AND n_years >= 3) d JOIN y ON y.basin_id = d.basin_id AND y.k = d.k GROUP BY 1, 2, 3),
e AS (SELECT t.basin_id, rep, q, unnest(range(times)) FROM t JOIN x ON x.basin_id = t.basin_id AND x.wy = t.wy),
s AS (SELECT basin_id, rep, avg(q) AS q_mean, median(q) AS q_median, quantile_cont(q, 0.05) AS q5, quantile_cont(q, 0.95) AS q95, CASE WHEN avg(q) > 0 THEN stddev_pop(q) / avg(q) END AS flow_variability FROM e GROUP BY 1, 2),
v AS (UNPIVOT s ON q_mean, q_median, q5, q95, flow_variability INTO NAME statistic VALUE v)
SELECT v.basin_id, statistic, round(max(v) FILTER (rep = -1), 4) AS value, round(quantile_cont(v, 0.05) FILTER (rep >= 0), 4) AS ci_low, round(quantile_cont(v, 0.95) FILTER (rep >= 0), 4) AS ci_high, any_value(n_years) AS n_years, CASE WHEN any_value(n_years) < 3 THEN 'too_few_complete_years' END AS reason FROM v JOIN u ON u.basin_id = v.basin_id GROUP BY 1, 2""")
def flow_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = uncertainty.flow_intervals(_all_regions(spark, sf_dir), min_years=3)
    number = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), 4).alias(c)
    return out.select("basin_id", "statistic", *map(number, ("value", "ci_low", "ci_high")), "n_years", "reason")


@query()
def runoff_ratio_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncertainty.resampled_ratio(series.align(daily_flow(spark, sf_dir), precipitation(spark, sf_dir), 1), "q", "p")


@query(f"""WITH {DAILY}, a AS (SELECT basin_id, 'q_mean' AS signature, avg(q) AS value FROM daily WHERE year(d) < 1999 GROUP BY 1 UNION ALL SELECT basin_id, 'q5', quantile_cont(q, 0.05) FROM daily WHERE year(d) < 1999 GROUP BY 1 UNION ALL SELECT basin_id, 'q95', quantile_cont(q, 0.95) FROM daily WHERE year(d) < 1999 GROUP BY 1),
b AS (SELECT basin_id, 'q_mean' AS signature, avg(q) AS reference FROM daily WHERE year(d) >= 1999 GROUP BY 1 UNION ALL SELECT basin_id, 'q5', quantile_cont(q, 0.05) FROM daily WHERE year(d) >= 1999 GROUP BY 1 UNION ALL SELECT basin_id, 'q95', quantile_cont(q, 0.95) FROM daily WHERE year(d) >= 1999 GROUP BY 1),
j AS (SELECT a.basin_id, a.signature, value, reference, CASE WHEN a.basin_id > 0 THEN (100.0 + a.basin_id) / 100.0 END AS ratio FROM a JOIN b ON b.basin_id = a.basin_id AND b.signature = a.signature),
k AS (SELECT *, CASE WHEN ratio IS NULL THEN value ELSE value * ratio END - reference AS diff FROM j)
SELECT basin_id, signature, round(value, 4) AS value, round(reference, 4) AS reference, round(diff, 4) AS diff, round(diff / reference, 6) AS rel_diff,
CASE WHEN ratio IS NULL THEN 'area_unknown' ELSE 'area_differs' END || ',period_differs' AS blockers, false AS can_claim_difference FROM k""")
def reference_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_flow(spark, sf_dir)
    early, late = (signatures.flow_stats(d.where(c), 1).select("basin_id", "q_mean", "q5", "q95") for c in ("year(d) < 1999", "year(d) >= 1999"))
    rows = [(b, 100.0 + b if b else None, 100.0, "1995", "1999", "Daymet v4", "daymet", True) for b in range(5)]
    context = spark.createDataFrame(rows, "basin_id int, area_used double, area_ref double, period_used string, period_ref string, product string, forcing_ref string, definitions_known boolean")
    c = compare.comparison(early, late, context)
    return c.select("basin_id", "signature", *(F.round(x, n).alias(x) for x, n in (("value", 4), ("reference", 4), ("diff", 4), ("rel_diff", 6))), "blockers", "can_claim_difference")


@query("""WITH x AS (SELECT p_partkey, p_retailprice / 20 AS p, 30 + p_size AS cn FROM part), s AS (SELECT *, 25400.0 / cn - 254.0 AS s FROM x)
SELECT p_partkey, round(s, 6) AS storage_mm, round(CASE WHEN p <= 0.2 * s THEN 0 ELSE (p - 0.2 * s) ** 2 / (p + 0.8 * s) END, 6) AS runoff_mm FROM s""")
def scs_runoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 20).alias("p"), (30 + F.col("p_size")).alias("cn"))
    return x.select("p_partkey", F.round(runoff.storage(F.col("cn")), 6).alias("storage_mm"), F.round(runoff.curve_number_runoff(F.col("p"), F.col("cn")), 6).alias("runoff_mm"))


@query("""WITH b AS (SELECT s_suppkey AS basin_id, 10.0 + s_nationkey AS area, 1.0 + s_nationkey / 5.0 AS tc, 25.0 AS ro FROM supplier),
t AS (SELECT *, 0.6 * tc + 0.133 * tc / 2 AS tp FROM b), u AS (SELECT *, 2.67 * tp AS tb, 0.208 * area * ro / tp AS qp FROM t),
n AS (SELECT *, greatest(CAST(ceil(tb / (tp / 10)) AS INTEGER) + 1, 3) AS n FROM u), s AS (SELECT *, unnest(generate_series(0, n - 1)) AS step FROM n), h AS (SELECT *, tb * step / (n - 1) AS t FROM s)
SELECT basin_id, CAST(step AS INTEGER) AS step, round(t, 4) AS time_hr, round(CASE WHEN t <= tp THEN qp * t / tp ELSE greatest(qp * (tb - t) / (tb - tp), 0) END, 4) AS discharge_cms FROM h""")
def hydrograph_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("basin_id"), (10.0 + F.col("s_nationkey")).alias("area_km2"), (1.0 + F.col("s_nationkey") / 5.0).alias("tc_hr"), F.lit(25.0).alias("runoff_mm"))
    return runoff.hydrographs(b)


@query("""WITH x AS (SELECT p_partkey, p_size AS sand, 100.0 - p_size - 20 AS silt, 20.0 AS clay, p_size / 5.0 AS slope, 20.0 + p_size AS len FROM part),
k AS (SELECT *, (0.2 + 0.3 * exp(-0.0256 * sand * (1 - silt / 100))) * power(silt / (clay + silt), 0.3) * (1 - 0.25 / (1 + exp(3.72 - 2.95))) * (1 - 0.7 * (1 - sand / 100) / ((1 - sand / 100) + exp(-5.51 + 22.9 * (1 - sand / 100)))) * 0.1317 AS k,
    sin(atan(slope / 100)) AS s, CASE WHEN slope >= 5 THEN 0.5 WHEN slope >= 3 THEN 0.4 WHEN slope >= 1 THEN 0.3 ELSE 0.2 END AS m FROM x),
l AS (SELECT *, power(len / 22.13, m) * (65.41 * s * s + 4.56 * s + 0.065) AS ls FROM k)
SELECT p_partkey, round(k, 8) AS k_factor, round(ls, 6) AS ls_factor, round(100.0 * k * ls * 0.1, 6) AS soil_loss FROM l""")
def rusle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    k, ls = runoff.k_factor(s, 100.0 - s - 20, F.lit(20.0)), runoff.ls_factor(s / 5.0, 20.0 + s)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(k, 8).alias("k_factor"), F.round(ls, 6).alias("ls_factor"), F.round(runoff.rusle(F.lit(100.0), k, ls, F.lit(0.1)), 6).alias("soil_loss"))


@query(f"""WITH {DAILY}, m AS (SELECT basin_id, month(d) AS mo, sum(q) / 1e6 AS p FROM daily GROUP BY 1, 2), f AS (SELECT basin_id, sum(p * p) / sum(p) AS f FROM m GROUP BY 1 HAVING count(*) = 12)
SELECT basin_id, round(f, 6) AS mfi, round(CASE WHEN f <= 55 THEN 0.07397 * power(f, 1.847) ELSE 95.77 - 6.081 * f + 0.4770 * f * f END, 4) AS r_factor FROM f""")
def rainfall_erosivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = daily_flow(spark, sf_dir).groupBy("basin_id", F.month("d").alias("m")).agg((F.sum("q") / 1e6).alias("p"))
    a = m.groupBy("basin_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "p"))), lambda s: s["p"]).alias("p")).where(F.size("p") == 12)
    return a.select("basin_id", F.round(runoff.fournier(F.col("p")), 6).alias("mfi"), F.round(runoff.r_factor(F.col("p")), 4).alias("r_factor"))


_NAMES = ["Deciduous Forest", "Open Water", "shrub/scrub", "Wooded Wetland", "Cropland", "Barren Land", "Moss", "Unknown", "developed, low", "Grassland"]
_COVER_SQL = " ".join(f"WHEN contains(k, '{n}') THEN {v}" for n, v in runoff.COVER)


@query(f"WITH x AS (SELECT p_partkey, lower({_NAMES!r}[p_partkey % 10 + 1]) AS k FROM part) SELECT p_partkey, CAST(CASE {' '.join(f'''WHEN k = '{n}' THEN {v}''' for n, v in runoff.COVER)} {_COVER_SQL} ELSE 0.1 END AS DOUBLE) AS c_factor FROM x")
def cover_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    return table(spark, sf_dir, "part").select("p_partkey", runoff.c_factor(F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int"))).alias("c_factor"))


_CLASSES = list(landsoil.CURVE_NUMBERS)
_CN_SQL = f"cn_table(class, g, cn) AS (VALUES {', '.join(f'({c}, {g}, {v})' for c, vs in landsoil.CURVE_NUMBERS.items() for g, v in enumerate(vs, 1))}), cells AS (SELECT p_partkey, CAST(p_partkey // 500 AS INTEGER) AS raster_id, CASE WHEN p_size = 50 THEN 99 ELSE {_CLASSES!r}[p_size % 16 + 1] END AS class, CAST(1 + p_partkey % 4 AS INTEGER) AS g, p_partkey % 3 > 0 AND p_partkey // 500 > 0 AS inside FROM part)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    classes = F.array(*map(F.lit, _CLASSES))
    cls = F.when(F.col("p_size") == 50, 99).otherwise(F.element_at(classes, F.col("p_size") % 16 + 1))
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(k / 500).cast("int").alias("raster_id"), cls.alias("class"), (1 + k % 4).cast("int").alias("group"), ((k % 3 > 0) & (F.floor(k / 500) > 0)).alias("inside"))


@query(f"WITH {_CN_SQL} SELECT p_partkey, CAST(c.class AS INTEGER) AS class, c.g AS \"group\", CAST(t.cn AS INTEGER) AS cn FROM cells c LEFT JOIN cn_table t ON t.class = c.class AND t.g = c.g")
def cn_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landsoil.overlay(_cells(spark, sf_dir)).select("p_partkey", "class", "group", "cn")


@query(f"""WITH {_CN_SQL}, v AS (SELECT c.raster_id, c.inside, t.cn, max(CASE WHEN c.inside THEN 1 END) OVER (PARTITION BY c.raster_id) AS has FROM cells c JOIN cn_table t ON t.class = c.class AND t.g = c.g)
SELECT raster_id, round(avg(cn), 6) AS cn_mean, median(cn) AS cn_median, CAST(min(cn) AS DOUBLE) AS cn_min, CAST(max(cn) AS DOUBLE) AS cn_max, round(stddev_pop(cn), 6) AS cn_std, round(quantile_cont(cn, 0.1), 6) AS cn_p10, quantile_cont(cn, 0.25) AS cn_p25, quantile_cont(cn, 0.75) AS cn_p75, round(quantile_cont(cn, 0.9), 6) AS cn_p90,
round(avg(CASE WHEN cn < 70 THEN 100.0 ELSE 0 END), 6) AS low_pct, round(avg(CASE WHEN cn BETWEEN 70 AND 85 THEN 100.0 ELSE 0 END), 6) AS medium_pct, round(avg(CASE WHEN cn > 85 THEN 100.0 ELSE 0 END), 6) AS high_pct, CASE WHEN max(has) IS NULL THEN 'raster_extent' ELSE 'basin_polygon' END AS stats_basis
FROM v WHERE inside OR has IS NULL GROUP BY 1""")
def cn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = landsoil.curve_number_stats(landsoil.overlay(_cells(spark, sf_dir)))
    return s.select("raster_id", *(F.round(c, 6).alias(c) for c in s.columns[1:-1]), "stats_basis")


@query(f"WITH {_CN_SQL} SELECT raster_id, CAST(class AS INTEGER) AS class, count(*) AS n_cells, round(count(*) / sum(count(*)) OVER (PARTITION BY raster_id), 8) AS fraction FROM cells WHERE class <> 99 GROUP BY 1, 2")
def lulc_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landsoil.class_fractions(_cells(spark, sf_dir), 99).withColumn("fraction", F.round("fraction", 8))


@query(f"WITH m(a, b) AS (VALUES {', '.join(map(str, landsoil.REMAP['worldcover'].items()))}) SELECT p_partkey, CAST(b AS INTEGER) AS class FROM part LEFT JOIN m ON m.a = p_size")
def lulc_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landsoil.remapped(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("class")), "worldcover").select("p_partkey", "class")


@query("""WITH x AS (SELECT p_partkey, p_size * 2 - 2 AS sand, CAST(p_partkey % 55 AS INTEGER) AS clay, (p_partkey % 40) / 2.0 AS ksat FROM part), y AS (SELECT *, 100 - sand - clay AS silt FROM x),
b AS (SELECT *, CASE WHEN (sand >= 50 AND sand <= 70 AND clay < 20) OR (silt > 50 AND clay < 27) THEN 2 WHEN sand > 70 AND clay < 10 THEN 1 WHEN clay >= 20 AND clay < 40 THEN 3 ELSE 4 END AS g FROM y)
SELECT p_partkey, g AS texture_group, CASE WHEN ksat > 15 THEN 1 WHEN ksat > 5 AND g > 2 THEN 2 WHEN ksat > 1.5 AND ksat <= 5 AND g > 3 THEN 3 ELSE g END AS refined_group FROM b""")
def soil_texture_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sand, clay, ksat = F.col("p_size") * 2 - 2, (F.col("p_partkey") % 55).cast("int"), (F.col("p_partkey") % 40) / 2.0
    silt = 100 - sand - clay
    return table(spark, sf_dir, "part").select("p_partkey", landsoil.texture_group(sand, silt, clay).alias("texture_group"), landsoil.texture_group(sand, silt, clay, ksat).alias("refined_group"))


_COMPONENTS = "c AS (SELECT l_suppkey AS mukey, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS pct, CASE WHEN l_linenumber = 7 THEN '' ELSE ['A', 'B/D', 'C', 'D', ' C/D '][l_orderkey % 5 + 1] END AS hydgrp, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS kw, l_tax AS clay FROM lineitem)"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.element_at(F.array(*map(F.lit, ("A", "B/D", "C", "D", " C/D "))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("mukey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("comppct"), F.when(F.col("l_linenumber") == 7, "").otherwise(groups).alias("hydgrp"),
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")).alias("kw"), F.lit(None).cast("double").alias("sand"), F.lit(None).cast("double").alias("silt"), F.col("l_tax").alias("clay"),
    )


@query(f"""WITH {_COMPONENTS}, a AS (SELECT mukey, round(sum(pct * kw) / sum(pct) FILTER (kw IS NOT NULL), 6) AS kw, round(sum(pct * clay) / sum(pct), 6) AS clay, arg_min(trim(hydgrp), struct_pack(a := -pct, b := seq)) FILTER (trim(hydgrp) <> '') AS hydgrp FROM c GROUP BY 1)
SELECT mukey, kw, clay, hydgrp, CAST(CASE hydgrp[1] WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 END AS INTEGER) AS drained, CAST(CASE hydgrp[-1] WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 END AS INTEGER) AS undrained, coalesce(contains(hydgrp, '/'), false) AS is_dual FROM a""")
def soil_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = landsoil.summarize_components(_components(spark, sf_dir)).withColumn("g", landsoil.drainage_groups(F.col("hydgrp")))
    return s.select("mukey", F.round("kw", 6).alias("kw"), F.round("clay", 6).alias("clay"), "hydgrp", "g.drained", "g.undrained", "g.is_dual")


@query("""WITH g AS (SELECT CAST(p_partkey // 500 AS INTEGER) AS raster_id, p_suppkey AS mukey FROM (SELECT p_partkey, p_partkey % 7 AS p_suppkey FROM part)), u AS (SELECT *, CASE mukey WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 4 END AS drained, mukey IN (2, 3) AS is_dual FROM g)
SELECT raster_id, count(DISTINCT mukey) AS n_units, round(avg(CASE WHEN drained IS NOT NULL THEN 1.0 ELSE 0 END), 8) AS coverage, round(avg(CASE WHEN drained = 1 THEN 100.0 ELSE 0 END) FILTER (drained IS NOT NULL), 6) AS group_a_pct, round(avg(CASE WHEN drained = 2 THEN 100.0 ELSE 0 END) FILTER (drained IS NOT NULL), 6) AS group_b_pct,
round(avg(CASE WHEN drained = 3 THEN 100.0 ELSE 0 END) FILTER (drained IS NOT NULL), 6) AS group_c_pct, round(avg(CASE WHEN drained = 4 THEN 100.0 ELSE 0 END) FILTER (drained IS NOT NULL), 6) AS group_d_pct, round(avg(CASE WHEN is_dual THEN 100.0 ELSE 0 END) FILTER (drained IS NOT NULL), 6) AS dual_pct FROM u GROUP BY 1""")
def soil_unit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 500).cast("int").alias("raster_id"), (F.col("p_partkey") % 7).alias("mukey"))
    units = spark.createDataFrame([(1, "A"), (2, "B/D"), (3, "B/D"), (4, "D"), (5, "D"), (6, "D")], "mukey long, hydgrp string").withColumn("kw", F.lit(0.3))
    s = landsoil.unit_shares(landsoil.spread(cells, units).select("raster_id", "mukey", F.col("g.drained").alias("drained"), F.col("g.is_dual").alias("is_dual")))
    return s.select("raster_id", "n_units", F.round("coverage", 8).alias("coverage"), *(F.round(c, 6).alias(c) for c in s.columns[3:]))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit(0).alias("raster_id"), F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), F.col("p_size").cast("double").alias("value"))


_GRID = "grid AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS r, CAST(p_partkey % 50 AS INTEGER) AS c, CAST(p_size AS DOUBLE) AS v FROM part)"
_NEAR = " ".join(f"LEFT JOIN grid n{i} ON n{i}.r = g.r + {r} AND n{i}.c = g.c + {c}" for i, (r, c) in enumerate((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)))


@query(f"""WITH {_GRID}, x AS (SELECT g.r, g.c, (n2.v + 2 * n5.v + n8.v - n0.v - 2 * n3.v - n6.v) / 240 AS dx, (n6.v + 2 * n7.v + n8.v - n0.v - 2 * n1.v - n2.v) / 240 AS dy FROM grid g {_NEAR})
SELECT 0 AS raster_id, r AS "row", c AS col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope_deg FROM x""")
def slope_horn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.slope_horn(_grid(spark, sf_dir), 30.0).withColumn("slope_deg", F.round("slope_deg", 6))


@query(f"""WITH {_GRID}, x AS (SELECT g.r, g.c, coalesce((e.v - w.v) / 60, (e.v - g.v) / 30, (g.v - w.v) / 30) AS dx, coalesce((s.v - n.v) / 60, (s.v - g.v) / 30, (g.v - n.v) / 30) AS dy FROM grid g
LEFT JOIN grid e ON e.r = g.r AND e.c = g.c + 1 LEFT JOIN grid w ON w.r = g.r AND w.c = g.c - 1 LEFT JOIN grid s ON s.r = g.r + 1 AND s.c = g.c LEFT JOIN grid n ON n.r = g.r - 1 AND n.c = g.c)
SELECT 0 AS raster_id, r AS "row", c AS col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope_deg FROM x""")
def slope_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.slope_gradient(_grid(spark, sf_dir), 30.0, 30.0).withColumn("slope_deg", F.round("slope_deg", 6))


@query("""WITH t AS (SELECT CAST(p_partkey // 500 AS INTEGER) AS raster_id, ln(p_retailprice * 30 / tan(radians(greatest(p_size / 10.0, 0.1)))) AS twi FROM part)
SELECT raster_id, round(avg(twi), 6) AS mean, round(min(twi), 6) AS min, round(max(twi), 6) AS max, round(stddev_pop(twi), 6) AS std, round(avg(CASE WHEN twi < 6 THEN 100.0 ELSE 0 END), 6) AS low_pct, round(avg(CASE WHEN twi BETWEEN 6 AND 10 THEN 100.0 ELSE 0 END), 6) AS mid_pct, round(avg(CASE WHEN twi > 10 THEN 100.0 ELSE 0 END), 6) AS high_pct FROM t GROUP BY 1""")
def zone_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 500).cast("int").alias("raster_id"), terrain.wetness_index(F.col("p_retailprice"), F.col("p_size") / 10.0, 30.0).alias("twi"))
    s = terrain.zone_shares(cells)
    return s.select("raster_id", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@query("""WITH x AS (SELECT p_partkey, p_retailprice AS a, 4.5 * sqrt(p_retailprice) AS p, 1.5 * sqrt(p_retailprice) AS l, p_size * 20.0 AS h FROM part), d AS (SELECT *, greatest(0.5, least(0.5 + h / 1000, 5.0)) AS d, h / (1.5 * l * 1000) AS s FROM x)
SELECT p_partkey, round(a / (l * l), 8) AS form_factor, round(4 * pi() * a / (p * p), 8) AS circularity, round(2 * sqrt(a / pi()) / l, 8) AS elongation, round(l * l / a, 8) AS shape_factor, round(l / sqrt(a), 8) AS unity,
round(d, 8) AS drainage_density, round(h / 1000 * d, 8) AS ruggedness, round(1 / d, 8) AS channel_maintenance, round(d * a / p, 6) AS fineness, round(d * a / a, 8) AS stream_frequency, round(1.5 * l, 6) AS main_channel_km, round(s, 10) AS channel_slope, round(0.75 * s, 10) AS slope_10_85,
round(a / (s * sqrt(d)), 2) AS hkr, round(l / 2 / sqrt(s), 4) AS gray, round(l * l / a / a, 10) AS murphey FROM d""")
def geomorphic_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("p_retailprice")
    p, length, h = 4.5 * F.sqrt(a), 1.5 * F.sqrt(a), F.col("p_size") * 20.0
    shape, streams_ = terrain.shape_indices(a, p, length), terrain.stream_metrics(a, p, length, h)
    more = terrain.advanced_indices(a, shape["shape_factor"], streams_["channel_slope"], streams_["drainage_density"], length / 2)
    digits = {"fineness": 6, "main_channel_km": 6, "channel_slope": 10, "slope_10_85": 10, "hkr": 2, "gray": 4, "murphey": 10}
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(c, digits.get(n, 8)).alias(n) for n, c in (shape | streams_ | more).items()))


@query("""WITH g AS (SELECT p_partkey // 500 AS ra, p_partkey // 50 AS r, p_partkey % 50 AS c, CAST(p_size AS DOUBLE) AS v FROM part), t AS (SELECT ra, max(v) AS z FROM g GROUP BY 1),
n AS (SELECT o.ra, arg_min(g.v, struct_pack(ring := greatest(abs(g.r - o.r), abs(g.c - o.c)), v := g.v)) AS zo FROM g o JOIN g ON g.ra = o.ra AND abs(g.r - o.r) <= 3 AND abs(g.c - o.c) <= 3 WHERE o.r % 10 = 5 AND o.c = 5 GROUP BY 1)
SELECT CAST(t.ra AS INTEGER) AS raster_id, z AS z_max, zo AS z_outlet, CASE WHEN zo IS NOT NULL THEN greatest(0, z - zo) END AS h_m FROM t LEFT JOIN n ON n.ra = t.ra""")
def relief_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relief of rasters of ten rows, each above an outlet of its own."""
    cells = _grid(spark, sf_dir).withColumn("raster_id", F.floor(F.col("row") / 10).cast("int"))
    return terrain.relief(cells, cells.where((F.col("row") % 10 == 5) & (F.col("col") == 5)).select("raster_id", "row", "col"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("comid"), F.floor(F.col("p_partkey") / 2).cast("long").alias("nextdown"), F.col("p_size").cast("double").alias("area_km2"))


_EDGES = "edges AS (SELECT p_partkey AS comid, p_partkey // 2 AS nextdown, CAST(p_size AS DOUBLE) AS area_km2 FROM part WHERE p_partkey >= 1)"


@query(f"WITH RECURSIVE {_EDGES}, up(outlet, comid) AS (SELECT comid, comid FROM edges WHERE comid IN (2, 3, 17) UNION ALL SELECT u.outlet, e.comid FROM up u JOIN edges e ON e.nextdown = u.comid) SELECT outlet, comid FROM up")
def upstream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.upstream(_edges(spark, sf_dir), spark.createDataFrame([(2,), (3,), (17,)], "comid long"))


@query(f"WITH RECURSIVE {_EDGES}, up(outlet, comid) AS (SELECT comid, comid FROM edges UNION ALL SELECT u.outlet, e.comid FROM up u JOIN edges e ON e.nextdown = u.comid) SELECT outlet, comid FROM up")
def upstream_closure_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``upstream_closure`` of all units."""
    e = _edges(spark, sf_dir)
    return network.upstream(e, e.select("comid"))


@query(f"WITH RECURSIVE {_EDGES}, dn(comid, outlet) AS (SELECT comid, comid FROM edges UNION ALL SELECT d.comid, e.nextdown FROM dn d JOIN edges e ON e.comid = d.outlet WHERE e.nextdown > 0) SELECT d.outlet AS comid, count(*) AS n_upstream, sum(e.area_km2) AS area_km2 FROM dn d JOIN edges e ON e.comid = d.comid GROUP BY 1")
def upstream_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.upstream_totals(_edges(spark, sf_dir))


_CELLS_XY = "cells AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS r, CAST(p_partkey % 50 AS INTEGER) AS c, (p_partkey % 50) * 100.0 AS x, (p_partkey // 50) * 100.0 AS y, p_retailprice / 1000 AS upa FROM part), outlets AS (SELECT s_suppkey AS outlet_id, (s_suppkey * 37 % 50) * 100.0 + 20 AS x, (s_suppkey * 13 % 4) * 100.0 + 30 AS y, 1.2 AS expected FROM supplier)"


def _snap_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    cells = table(spark, sf_dir, "part").select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), ((k % 50) * 100.0).alias("x"), (F.floor(k / 50) * 100.0).alias("y"), (F.col("p_retailprice") / 1000).alias("upa"))
    outlets = table(spark, sf_dir, "supplier").select(s.alias("outlet_id"), ((s * 37 % 50) * 100.0 + 20).alias("x"), ((s * 13 % 4) * 100.0 + 30).alias("y"), F.lit(1.2).alias("expected_km2"))
    return outlets, cells


_SNAP = f"""WITH {_CELLS_XY}, j AS (SELECT o.outlet_id, o.expected, c.*, sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y)) AS dist FROM outlets o JOIN cells c ON abs(c.x - o.x) <= 300 AND abs(c.y - o.y) <= 300),
k AS (SELECT *, CASE WHEN upa >= 1 THEN 0 WHEN upa > 0 THEN 1 ELSE 2 END AS kind FROM j WHERE dist <= 300), b AS (SELECT *, min(kind) OVER (PARTITION BY outlet_id) AS bk FROM k), m AS (SELECT *, max(ln(1 + upa)) OVER (PARTITION BY outlet_id) AS mx FROM b WHERE kind = bk),
s AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY SCORE, r, c) AS n FROM m) SELECT outlet_id, r AS "row", c AS col, round(dist, 6) AS dist, upa FROM s WHERE n = 1"""


@query(_SNAP.replace("SCORE", "dist / 300 - 0.2 * ln(1 + upa) / greatest(mx, 1)"))
def snap_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.snap(*_snap_tables(spark, sf_dir), 300.0).drop("quality").withColumn("dist", F.round("dist", 6))


@query(_SNAP.replace("SCORE", "abs(upa - expected) / greatest(expected, 1) + 0.35 * dist / 300"))
def snap_expected_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.snap(*_snap_tables(spark, sf_dir), 300.0, expected=True).drop("quality").withColumn("dist", F.round("dist", 6))


@query(f"""WITH {_CELLS_XY}, j AS (SELECT o.*, c.r, c.c, c.upa, sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y)) AS dist FROM outlets o JOIN cells c ON abs(c.x - o.x) <= 300 AND abs(c.y - o.y) <= 300),
g AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY round(dist, 3), abs(upa - expected) / expected, r, c) AS n FROM j WHERE dist <= 300 AND upa >= 1 AND abs(upa - expected) <= 0.1 * expected),
k AS (SELECT *, CASE WHEN upa >= 1 THEN 0 WHEN upa > 0 THEN 1 ELSE 2 END AS kind FROM j WHERE dist <= 300), b AS (SELECT *, min(kind) OVER (PARTITION BY outlet_id) AS bk FROM k), m AS (SELECT *, max(ln(1 + upa)) OVER (PARTITION BY outlet_id) AS mx FROM b WHERE kind = bk),
s AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY dist / 300 - 0.2 * ln(1 + upa) / greatest(mx, 1), r, c) AS n FROM m)
SELECT outlet_id, r AS "row", c AS col, round(dist, 6) AS dist, upa, 'area_gated' AS quality FROM g WHERE n = 1
UNION ALL SELECT outlet_id, r, c, round(dist, 6), upa, 'nearest_merit_stream_area_gate_no_match' FROM s WHERE n = 1 AND outlet_id NOT IN (SELECT outlet_id FROM g)""")
def snap_area_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.snap_area_gated(*_snap_tables(spark, sf_dir), 300.0, 0.1).withColumn("dist", F.round("dist", 6))


@query("""WITH b AS (SELECT p_partkey AS comid, (p_partkey % 50) * 0.5 AS x0, (p_partkey // 50) * 0.5 AS y0, (p_partkey % 50) * 0.5 + 0.48 AS x1, (p_partkey // 50) * 0.5 + 0.48 AS y1, p_retailprice AS u FROM part), p AS (SELECT s_suppkey AS point_id, (s_suppkey * 7919 % 2400) / 100.0 AS x, (s_suppkey * 104729 % 190) / 100.0 AS y FROM supplier),
j AS (SELECT *, sqrt(greatest(x0 - x, 0, x - x1) ** 2 + greatest(y0 - y, 0, y - y1) ** 2) AS dist FROM p JOIN b ON x BETWEEN x0 - 0.05 AND x1 + 0.05 AND y BETWEEN y0 - 0.05 AND y1 + 0.05), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(dist, 9), u DESC, comid) AS n FROM j WHERE dist <= 0.05)
SELECT point_id, comid, round(dist, 6) AS dist FROM k WHERE n = 1""")
def locate_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    x0, y0 = (k % 50) * 0.5, F.floor(k / 50) * 0.5
    boxes = table(spark, sf_dir, "part").select(k.alias("comid"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.48).alias("x1"), (y0 + 0.48).alias("y1"), F.col("p_retailprice").alias("uparea"))
    points = table(spark, sf_dir, "supplier").select(s.alias("point_id"), ((s * 7919 % 2400) / 100.0).alias("x"), ((s * 104729 % 190) / 100.0).alias("y"))
    return network.locate(points, boxes).withColumn("dist", F.round("dist", 6))


@query("SELECT p_partkey, CASE WHEN u >= 10000 THEN 0 WHEN u >= 2500 THEN 1 WHEN u >= 500 THEN 2 WHEN u >= 100 THEN 3 ELSE 4 END AS band FROM (SELECT p_partkey, CASE WHEN p_size < 48 THEN p_size * p_retailprice / 4 END AS u FROM part)")
def river_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.col("p_size") < 48, F.col("p_size") * F.col("p_retailprice") / 4)
    return table(spark, sf_dir, "part").select("p_partkey", network.river_band(u).alias("band"))


@query("SELECT p_partkey, CASE WHEN v IN (0, 1, 2, 4, 8, 16, 32, 64, 128) THEN v ELSE 247 END AS code, CASE WHEN v IN (1, 2, 128) THEN 1 WHEN v IN (4, 64) THEN 0 WHEN v IN (8, 16, 32) THEN -1 END + c AS to_col FROM (SELECT p_partkey, p_size AS v, CAST(p_partkey % 50 AS INTEGER) AS c FROM part)")
def d8_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("raster_id"), F.lit(0).alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.col("p_size").alias("value"))
    e = network.d8_edges(cells).join(cells.select("raster_id", "value"), "raster_id")
    return e.select(F.col("raster_id").alias("p_partkey"), network.clean_direction(F.col("value")).alias("code"), "to_col")


@query("SELECT CAST(p_partkey // 500 AS INTEGER) AS raster_id, coalesce(bool_or(CASE WHEN p_size > 45 THEN (p_partkey % 500 // 50 < 2 OR p_partkey % 50 < 2 OR p_partkey % 500 // 50 >= 8 OR p_partkey % 50 >= 48) END), true) AS touches FROM part GROUP BY 1")
def basin_touches_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(F.floor(k / 500).cast("int").alias("raster_id"), F.floor(k % 500 / 50).alias("row"), (k % 50).alias("col"), (F.col("p_size") > 45).alias("inside"))
    return network.touches_edge(m, 10, 50)


@query("""WITH a AS (SELECT DISTINCT p_partkey // 500 AS raster_id, p_partkey AS k FROM part WHERE p_size <= 30), b AS (SELECT DISTINCT p_partkey // 500 AS raster_id, p_partkey AS k FROM part WHERE p_size >= 20), j AS (SELECT coalesce(a.raster_id, b.raster_id) AS raster_id, a.k AS ka, b.k AS kb FROM a FULL JOIN b ON a.k = b.k)
SELECT CAST(raster_id AS BIGINT) AS raster_id, count(ka) AS n_a, count(kb) AS n_b, count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL) AS n_both, round(count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL) / count(*), 8) AS iou FROM j GROUP BY 1""")
def realisation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 500).cast("long").alias("raster_id"), F.col("p_partkey").alias("k"), "p_size")
    return network.set_overlap(p.where("p_size <= 30"), p.where("p_size >= 20"), ["k"]).withColumn("iou", F.round("iou", 8))


_TIERS = "t AS (SELECT s_suppkey AS outlet_id, k AS tier_rank, ['service', 'hybrid', 'dem'][k] AS tier, 100 + abs(s_acctbal) * (1 + k / 10.0) AS area_km2, s_suppkey % (k + 2) = 0 AS ok FROM supplier, (VALUES (1), (2), (3)) v(k))"


@query(f"""WITH {_TIERS}, r AS (SELECT *, coalesce(min(CASE WHEN ok THEN tier_rank END) OVER w, max(tier_rank) OVER w) AS r FROM t WINDOW w AS (PARTITION BY outlet_id)), s AS (SELECT *, max(CASE WHEN tier_rank = r THEN area_km2 END) OVER (PARTITION BY outlet_id) AS served FROM r)
SELECT outlet_id, max(CASE WHEN tier_rank = r THEN tier END) AS tier, round(max(served), 4) AS area_km2, count(*) AS n_tried, bool_or(tier_rank < r AND abs(area_km2 - served) > 0.25 * served) AS disagrees, NOT bool_or(tier_rank = r AND ok) AS last_resort FROM s WHERE tier_rank <= r GROUP BY 1""")
def tier_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("tier_rank"))
    t = s.select(F.col("s_suppkey").alias("outlet_id"), "tier_rank", F.element_at(F.array(*map(F.lit, ("service", "hybrid", "dem"))), F.col("tier_rank")).alias("tier"), (100 + F.abs("s_acctbal") * (1 + F.col("tier_rank") / 10.0)).alias("area_km2"), (F.col("s_suppkey") % (F.col("tier_rank") + 2) == 0).alias("ok"))
    return reliability.route(t).withColumn("area_km2", F.round("area_km2", 4))


@query("""WITH x AS (SELECT s_suppkey, 1000.0 AS poly, CASE WHEN s_suppkey % 7 > 0 THEN 700 + (s_suppkey * 31 % 700) END AS rep, s_suppkey % 11 = 0 AS amb, s_suppkey % 2 = 0 AS ind FROM supplier), y AS (SELECT *, (poly - rep) / rep AS rel FROM x),
z AS (SELECT *, CASE WHEN rel IS NULL THEN 'unverified' WHEN abs(rel) <= 0.1 THEN 'verified' WHEN abs(rel) > 0.35 THEN 'mismatch' ELSE 'unverified' END AS status FROM y)
SELECT s_suppkey, round(rel, 4) AS rel_err, status, CASE WHEN status = 'mismatch' OR amb THEN 'ambiguous' WHEN status = 'verified' THEN 'verified' ELSE 'unverified' END AS state, CASE WHEN rep IS NULL THEN 'none' WHEN ind THEN 'independent_lookup' ELSE 'caller_area_also_steered_snap' END AS basis FROM z""")
def area_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    reported = F.when(s % 7 > 0, 700 + (s * 31 % 700))
    c = reliability.area_check(F.lit(1000.0), reported)
    return table(spark, sf_dir, "supplier").select("s_suppkey", c["rel_err"].alias("rel_err"), c["status"].alias("status"), reliability.reliability_state(c["status"], s % 11 == 0, F.lit(False)).alias("state"), reliability.state_basis(reported, s % 2 == 0).alias("basis"))


@query("""WITH x AS (SELECT p_partkey, p_size / 4.0 AS a, p_retailprice / 200 AS u, p_size / 3.0 AS e, p_partkey % 13 = 0 AS t FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN t THEN 'BASIN_TOUCHES_WINDOW_EDGE' END, CASE WHEN a < 1 THEN 'VERY_SMALL_BASIN' END, CASE WHEN abs(a - u) / u > 0.25 THEN 'MERIT_UPA_AREA_MISMATCH' END, CASE WHEN abs(a - e) / e > 0.25 THEN 'AREA_DIFFERS_FROM_EXPECTED' END) AS flags,
concat_ws(',', CASE WHEN p_partkey % 9000 > 5000 THEN 'OUTLET_SNAP_FAR' END, CASE WHEN abs(u - e) / e > 0.25 THEN 'SNAP_UPA_DIFFERS_FROM_EXPECTED' END) AS snap_flags FROM x""")
def area_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, u, e = F.col("p_size") / 4.0, F.col("p_retailprice") / 200, F.col("p_size") / 3.0
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(reliability.area_flags(a, u, e, F.col("p_partkey") % 13 == 0), ",").alias("flags"), F.array_join(reliability.snap_flags(F.col("p_partkey") % 9000, u, e), ",").alias("snap_flags"))


@query("""WITH x AS (SELECT p_partkey, p_size * 3000000 AS n, p_retailprice AS mb, p_partkey % 9 > 0 AS c, p_size / 5.0 AS a, CASE WHEN p_partkey % 3 = 0 THEN p_size / 4.0 END AS e, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice * 4 END AS s FROM part)
SELECT p_partkey, CASE WHEN NOT c OR n > 120000000 OR mb > 1500 THEN 'hybrid_required' WHEN n > 60000000 OR mb > 600 THEN 'scientific_allowed' ELSE 'interactive_ok' END AS envelope,
CASE WHEN a < 1 THEN 'below_minimum' WHEN p_partkey % 17 = 0 THEN 'extent_maxed' WHEN e > 0 AND abs(a - e) / e > 0.25 THEN 'area_differs' WHEN p_partkey % 2 = 0 THEN NULL WHEN (s IS NULL OR s > 5000) AND (coalesce(e, 0) > 10 OR a < 10) THEN 'snap_unavailable' END AS escalation FROM x""")
def routing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    e, s = F.when(k % 3 == 0, F.col("p_size") / 4.0), F.when(k % 5 > 0, F.col("p_retailprice") * 4)
    return table(spark, sf_dir, "part").select("p_partkey", reliability.envelope(F.col("p_size") * 3_000_000, F.col("p_retailprice"), k % 9 > 0, True).alias("envelope"), reliability.escalation(F.col("p_size") / 5.0, e, s, k % 17 == 0, k % 2 == 0).alias("escalation"))


@query("""WITH b AS (SELECT n_nationkey AS k, n_nationkey * 4.0 AS x0, n_regionkey * 5.0 AS y0, n_nationkey * 4.0 + 6 AS x1, n_regionkey * 5.0 + 7 AS y1 FROM nation), v AS (SELECT r_regionkey AS preset, r_regionkey * 20.0 AS x0, 0.0 AS y0, r_regionkey * 20.0 + 15 AS x1, 12.0 AS y1 FROM region)
SELECT DISTINCT v.preset, b.k AS code FROM v JOIN b ON b.x0 <= v.x1 AND b.x1 >= v.x0 AND b.y0 <= v.y1 AND b.y1 >= v.y0""")
def region_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("r_regionkey")
    boxes = table(spark, sf_dir, "nation").select(k.alias("code"), (k * 4.0).alias("x0"), (F.col("n_regionkey") * 5.0).alias("y0"), (k * 4.0 + 6).alias("x1"), (F.col("n_regionkey") * 5.0 + 7).alias("y1"))
    views = table(spark, sf_dir, "region").select(r.alias("preset"), (r * 20.0).alias("x0"), F.lit(0.0).alias("y0"), (r * 20.0 + 15).alias("x1"), F.lit(12.0).alias("y1"))
    return network.overlapping(views, boxes)


@query(f"""WITH {DENSE} SELECT basin_id, min(d) AS first_day, max(d) AS last_day, count(*) AS n_days, count(q) AS n_valid_days, 'sha256:' || sha256(string_agg(strftime(d, '%Y-%m-%d') || chr(9) || coalesce(CAST(q AS VARCHAR), 'nan') || chr(10), '' ORDER BY d)) AS digest, 'm3/s' AS units FROM dense GROUP BY 1""")
def series_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.extent(series.dense(daily_flow(spark, sf_dir)))


@query("""SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def streaming_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return streams.run_available(streams.daily_counts(stream), f"{network.shared_folder(spark)}/daily-counts-{uuid.uuid4().hex}").withColumn("total", F.round("total", 4))


@query(f"""WITH {DENSE}, gaps AS (SELECT basin_id, d - CAST(row_number() OVER (PARTITION BY basin_id ORDER BY d) AS INTEGER) AS g FROM dense WHERE q IS NULL), r AS (SELECT basin_id, g, count(*) AS k FROM gaps GROUP BY 1, 2)
SELECT basin_id, printf('%d days missing in %d ranges, the longest of %d days', CAST(sum(k) AS BIGINT), count(*), max(k)) AS note FROM r GROUP BY 1""")
def gap_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gap_notes(series.missing_ranges(daily_flow(spark, sf_dir)))


@query(f"""WITH {DAILY}, y AS (SELECT basin_id, year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS wy, avg(q) AS m FROM daily GROUP BY 1, 2)
SELECT a.basin_id, count(*) AS n_pairs, round(corr(a.m, b.m), 6) AS lag1 FROM y a JOIN y b ON a.basin_id = b.basin_id AND a.wy = b.wy + 1 GROUP BY 1""")
def annual_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.annual_persistence(daily_flow(spark, sf_dir)).withColumn("lag1", F.round("lag1", 6))


@query("""WITH x AS (SELECT p_partkey, 5.0 + p_size AS a, p_size / 4.0 AS tc, 40 + p_size AS cn, p_retailprice / 20 AS p FROM part), s AS (SELECT *, 25400.0 / cn - 254.0 AS s, 0.6 * tc + 0.133 * tc / 2 AS tp FROM x), q AS (SELECT *, CASE WHEN p <= 0.2 * s THEN 0 ELSE (p - 0.2 * s) ** 2 / (p + 0.8 * s) END AS q FROM s)
SELECT p_partkey, round(q, 6) AS runoff_mm, round(q / p, 6) AS runoff_coefficient, round(tp, 6) AS time_to_peak_hr, round(2.67 * tp, 6) AS base_time_hr, round(0.208 * a * q / tp, 6) AS peak_discharge_cms, round(q / 1000 * a * 1e6, 4) AS runoff_volume_m3 FROM q""")
def design_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    c = runoff.design_storm(5.0 + s, s / 4.0, 40 + s, F.col("p_retailprice") / 20)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(v, 4 if k == "runoff_volume_m3" else 6).alias(k) for k, v in c.items()))


@query(f"WITH {_GRID}, m AS (SELECT r, c FROM grid WHERE v > 20), e AS (SELECT r, c, unnest(['n', 's', 'w', 'e']) AS side, unnest([r - 1, r + 1, r, r]) AS nr, unnest([c, c, c - 1, c + 1]) AS nc FROM m) SELECT 0 AS raster_id, e.r AS \"row\", e.c AS col, side FROM e ANTI JOIN m ON m.r = e.nr AND m.c = e.nc")
def mask_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.boundary_edges(_grid(spark, sf_dir).where("value > 20").select("raster_id", "row", "col"))


@query(f"WITH RECURSIVE {_EDGES}, kept AS (SELECT * FROM edges WHERE area_km2 > 5), up(outlet, comid) AS (SELECT comid, comid FROM kept WHERE comid IN (2, 3, 17) UNION ALL SELECT u.outlet, e.comid FROM up u JOIN kept e ON e.nextdown = u.comid) SELECT outlet, comid FROM up")
def terminal_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return network.refine_terminal(e, e.where("area_km2 > 5").select("comid"), spark.createDataFrame([(2,), (3,), (17,)], "comid long"))


@query(f"WITH RECURSIVE {_EDGES}, kept AS (SELECT * FROM edges WHERE area_km2 > 5), up(outlet, comid) AS (SELECT comid, comid FROM kept UNION ALL SELECT u.outlet, e.comid FROM up u JOIN kept e ON e.nextdown = u.comid) SELECT outlet, comid FROM up")
def terminal_refinement_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``terminal_refinement`` of all units."""
    e = _edges(spark, sf_dir)
    return network.refine_terminal(e, e.where("area_km2 > 5").select("comid"), e.select("comid"))


@query("""WITH b AS (SELECT n_nationkey AS u, n_nationkey * 4.0 - 8 AS x0, n_regionkey * 4.0 - 6 AS y0, n_nationkey * 4.0 + 16 AS x1, n_regionkey * 4.0 + 7 AS y1, (n_nationkey * 7 % 11) AS a FROM nation), p AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 1000) / 10.0 AS x, (s_suppkey * 53 % 200) / 10.0 AS y FROM supplier)
SELECT k AS point_id, CAST(arg_min(u, struct_pack(a := a, u := u)) AS INTEGER) AS unit_id FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""")
def unit_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = F.col("n_nationkey"), F.col("n_regionkey"), F.col("s_suppkey")
    boxes = table(spark, sf_dir, "nation").select(n.cast("int").alias("unit_id"), (n * 4.0 - 8).alias("x0"), (r * 4.0 - 6).alias("y0"), (n * 4.0 + 16).alias("x1"), (r * 4.0 + 7).alias("y1"), (n * 7 % 11).alias("area"))
    points = table(spark, sf_dir, "supplier").select(s.alias("point_id"), ((s * 37 % 1000) / 10.0).alias("x"), ((s * 53 % 200) / 10.0).alias("y"))
    return network.smallest_holding(points, boxes)


@query("SELECT l_partkey AS tile_id, arg_min(l_shipmode_, struct_pack(a := l_suppkey * 10 + l_linenumber, b := l_shipmode_)) AS payload, count(*) AS n_sources FROM (SELECT l_partkey, l_suppkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1")
def tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tile_id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("source_rank"), F.concat("l_returnflag", "l_linestatus").alias("payload"))
    return network.merge_tiles(t)


@query("""SELECT s_suppkey, 'basin:' || substr(sha256(concat_ws('|', 'gauge:' || s_suppkey, 'v1', 'hybrid')), 1, 16) AS ref, s_suppkey % 700 > 300 OR s_suppkey % 9 = 0 OR (100 + s_suppkey % 60) > 1.25 * (60 + (1 - s_suppkey % 10 / 10.0) * 40) AS unreliable, 80 + s_suppkey % 20 < 0.9 * 100 AS off_reach,
CASE WHEN 3000 < 2 * (s_suppkey * 31 % 4000) THEN 'no_room' WHEN s_suppkey * 31 % 4000 <= 1000 THEN 'fetch' ELSE 'ask' END AS staging FROM supplier""")
def outlet_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    line = F.when(s % 9 != 0, s % 700)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", reliability.basin_ref(F.concat(F.lit("gauge:"), s.cast("string")), F.lit("v1"), F.lit("hybrid")).alias("ref"), reliability.unsnapped_unreliable(100 + s % 60, F.lit(40.0), F.lit(60.0), line, s % 10 / 10.0).alias("unreliable"),
        reliability.off_reach(80 + s % 20, F.lit(100.0)).alias("off_reach"), reliability.staging(s * 31 % 4000, F.lit(3000.0), "tiered", 1000.0).alias("staging"),
    )
