"""Scans, alignment, validation and gaps of daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.periods import finite

#: Limits of usable daily precipitation (days, mm/day).
MIN_DAYS, MAX_DAILY, MIN_MEAN, MAX_MEAN = 365, 2000.0, 1e-4, 35.0


def clean(daily: DataFrame, sequence: str | None = None) -> DataFrame:
    """Not-a-number becomes null; of rows for one day, the first in ``sequence`` stays."""
    out = daily.withColumn("q", F.nanvl("q", F.lit(None).cast("double")))
    if sequence is None:
        return out.dropDuplicates(["basin_id", "d"])
    first = Window.partitionBy("basin_id", "d").orderBy(sequence)
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def to_mm_per_day(q_cms: Column, area_km2: Column) -> Column:
    return q_cms * 86.4 / area_km2


def dense(daily: DataFrame) -> DataFrame:
    """Every day from each basin's first to its last; days without a row have a null ``q``."""
    span = daily.groupBy("basin_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = span.select("basin_id", F.explode(F.sequence("lo", "hi")).alias("d"))
    return days.join(daily.select("basin_id", "d", "q"), ["basin_id", "d"], "left")


def align(q: DataFrame, p: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """``(basin_id, d, q, p)`` of days that have both, for basins with at least ``min_days`` of them."""
    both = q.where("q IS NOT NULL").join(p.where("p IS NOT NULL"), ["basin_id", "d"])
    n = F.count("*").over(Window.partitionBy("basin_id"))
    return both.withColumn("_n", n).where(F.col("_n") >= min_days).drop("_n")


def islands(daily: DataFrame, flag: Column) -> DataFrame:
    """Runs of consecutive days on which ``flag`` holds: ``(basin_id, start, end, n_days)``."""
    w = Window.partitionBy("basin_id").orderBy("d")
    on = daily.where(flag).withColumn("_g", F.date_sub("d", F.row_number().over(w)))
    return on.groupBy("basin_id", "_g").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("n_days")).drop("_g")


def missing_ranges(daily: DataFrame, reasons: DataFrame | None = None, default: str = "absent_in_response") -> DataFrame:
    """``(basin_id, start, end, n_days, reason)`` of the days without a value; a new reason starts a new range.

    ``reasons``: ``(basin_id, start, end, reason, priority)``; a day takes that of the first range that holds it.
    """
    gaps = dense(daily).where("q IS NULL").select("basin_id", "d")
    if reasons is None:
        marked = gaps.withColumn("reason", F.lit(default))
    else:
        r = reasons.alias("r")
        hit = gaps.alias("g").join(r, F.expr("g.basin_id = r.basin_id AND g.d BETWEEN r.start AND r.end"), "left")
        marked = hit.groupBy("g.basin_id", "g.d").agg(F.min(F.when(F.col("r.reason").isNotNull(), F.struct("r.priority", "r.reason"))).alias("_r")).select("basin_id", "d", F.coalesce("_r.reason", F.lit(default)).alias("reason"))
    w = Window.partitionBy("basin_id").orderBy("d")
    fresh = (F.lag("d").over(w).isNull() | (F.datediff("d", F.lag("d").over(w)) > 1) | (F.lag("reason").over(w) != F.col("reason"))).cast("int")
    grouped = marked.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w))
    return grouped.groupBy("basin_id", "_g", "reason").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("n_days")).select("basin_id", "start", "end", "n_days", "reason")


#: Spellings of a unit of mm per day, without blanks.
MM_PER_DAY = ("mm/day", "mm/d", "mmday-1", "mmd-1", "mmday^-1", "mm.day-1", "kg/m2/day", "kgm-2day-1", "kgm-2d-1", "kg/m^2/day")


def unit_is_mm_per_day(unit: Column) -> Column:
    """Whether a unit means mm per day, whatever its case and blanks; a raised 2 is a 2."""
    return F.regexp_replace(F.replace(F.lower(unit), F.lit("²"), F.lit("2")), r"\s", "").isin(*MM_PER_DAY)


def effective_unit(declared: Column, of_product: Column) -> Column:
    """The unit to judge a series by: what it declares, else what its product has; null if neither says."""
    return F.coalesce(F.nullif(declared, F.lit("")), F.nullif(of_product, F.lit("")))


def accepted_coverage(coverage: DataFrame) -> DataFrame:
    """Of what a data service says of its series ``(basin_id, field, value)``, one row a basin with the fields in use:
    requested and received days, the range and the calendar; a count that is no whole number counts as absent."""
    text = lambda n: F.max(F.when(F.col("field") == n, F.col("value")))
    number = lambda n: F.try_to_number(F.when(F.rlike(text(n), F.lit("^[0-9]{1,9}$")), text(n)), F.lit("999999999")).cast("long")
    return coverage.groupBy("basin_id").agg(number("expected_days").alias("expected_days"), number("received_days").alias("received_days"), text("start").alias("start"), text("end").alias("end"), text("calendar").alias("calendar"))


def served(daily: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``(basin_id, d, q, units, qualifier, approval)`` as served; codes ``(basin_id, d, seq, qualifier, approval)`` are the
    first of their day, empty where a day has none, null for basins without any."""
    base = daily.select("basin_id", "d", F.when(finite(F.col("q")).isNotNull(), F.col("q")).alias("q"), F.lit("m3/s").alias("units"))
    if codes is None:
        return base.withColumn("qualifier", F.lit(None).cast("string")).withColumn("approval", F.lit(None).cast("string"))
    first = codes.groupBy("basin_id", "d").agg(F.min(F.struct("seq", "qualifier", "approval")).alias("c"))
    some = codes.select("basin_id").distinct().withColumn("known", F.lit(""))
    j = base.join(first, ["basin_id", "d"], "left").join(some, "basin_id", "left")
    return j.select("basin_id", "d", "q", "units", F.coalesce("c.qualifier", "known").alias("qualifier"), F.coalesce("c.approval", "known").alias("approval"))


def precipitation_problem(p: DataFrame, unit: str | None = None) -> DataFrame:
    """``(basin_id, n_days, reason)``: why a precipitation series ``(basin_id, d, p)`` cannot be used; null if it can."""
    value = finite(F.col("p"))
    facts = p.groupBy("basin_id").agg(
        F.count(value).alias("n_days"), F.count(F.when(F.abs("p") == float("inf"), 1)).alias("n_inf"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean")
    )
    bad_unit = F.lit(False) if unit is None or not unit.strip() else ~unit_is_mm_per_day(F.lit(unit))
    reason = (
        F.when(bad_unit, "unit")
        .when(F.col("n_inf") > 0, "not_finite")
        .when(F.col("n_days") < MIN_DAYS, "too_few_days")
        .when(F.col("lo") < 0, "negative")
        .when(F.col("hi") > MAX_DAILY, "max_out_of_range")
        .when(F.col("mean") < MIN_MEAN, "effectively_zero")
        .when(F.col("mean") > MAX_MEAN, "mean_out_of_range")
    )
    return facts.select("basin_id", "n_days", reason.alias("reason"))


def extent(daily: DataFrame) -> DataFrame:
    """Extent and digest of each series ``(basin_id, d, q)`` in m3/s: over all days, missing ones included, lines of day, tab
    and the shortest text of the value, each ended by a line feed, in order of days; a missing value is ``nan``."""
    value = F.when(F.col("q").isNull() | F.isnan("q"), "nan").otherwise(python_repr(F.col("q").cast("double")))
    line = F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("\t"), value, F.lit("\n"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("d", line.alias("l")))), lambda s: s["l"]))
    valid = F.count_if(F.col("q").isNotNull() & ~F.isnan("q") & (F.abs("q") < float("inf")))
    return daily.groupBy("basin_id").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n_days"), valid.alias("n_valid_days"), F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("digest"), F.lit("m3/s").alias("units"))


def python_repr(x: Column) -> Column:
    """The shortest text that gives a double again, as digests have it: plain below 1e16, exponents of two digits."""
    java = x.cast("string")
    mantissa, power = F.split_part(java, F.lit("E"), F.lit(1)), F.split_part(java, F.lit("E"), F.lit(2)).cast("int")
    digits = F.regexp_replace(F.ltrim(mantissa, F.lit("-")), r"\.0$|\.", "")
    sign = F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.when(F.length(digits) > power + 1, F.concat(sign, F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(F.concat(sign, F.rpad(digits, power + 1, F.lit("0")), F.lit(".0")))
    far = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    return F.when(~F.contains(java, F.lit("E")), java).when((power >= -4) & (power < 0), small).when((power >= 0) & (power < 16), large).otherwise(far)


def provenance(p: DataFrame, unit: str | None = None) -> DataFrame:
    """Record of each precipitation series as received: extent, days, total, whether it is usable and why not, and the
    digest over lines of day, tab and shortest number, each ended."""
    line = F.struct("d", F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("\t"), python_repr(F.col("p")), F.lit("\n")).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["l"]), "")
    a = p.where("p IS NOT NULL").groupBy("basin_id").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.sum("p").alias("total"), F.sha2(text, 256).alias("digest"))
    return a.join(precipitation_problem(p, unit), "basin_id").withColumn("usable", F.col("reason").isNull())


def gauge_area_ok(gauge: Column, polygon: Column, tolerance: float = 1.10) -> Column:
    return F.abs(F.ln(gauge / polygon)) <= F.ln(F.lit(tolerance))


def gap_notes(ranges: DataFrame) -> DataFrame:
    """``(basin_id, note)`` in words, from ``missing_ranges``."""
    a = ranges.groupBy("basin_id").agg(F.count("*").alias("n"), F.sum("n_days").alias("days"), F.max("n_days").alias("longest"))
    return a.select("basin_id", F.format_string("%d days missing in %d ranges, the longest of %d days", "days", "n", "longest").alias("note"))


def annual_persistence(daily: DataFrame) -> DataFrame:
    """``(basin_id, n_pairs, lag1)``: correlation of the mean flow of consecutive water years."""
    from tarnflow.operators import periods

    y = daily.where("q IS NOT NULL").groupBy("basin_id", periods.label(F.col("d"), "water").alias("wy")).agg(F.avg("q").alias("m"))
    pairs = y.join(y.select("basin_id", (F.col("wy") + 1).alias("wy"), F.col("m").alias("before")), ["basin_id", "wy"])
    return pairs.groupBy("basin_id").agg(F.count("*").alias("n_pairs"), F.corr("m", "before").alias("lag1"))
