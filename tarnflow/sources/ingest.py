"""Readers: daily series from CSV and Parquet, vector features from GeoJSON, digests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes for missing values.
MISSING = ("-999", "-9999")


def read_daily_csv(spark: SparkSession, path: str, date_col: str = "date", value_col: str = "q_cms", missing: tuple[str, ...] = MISSING) -> DataFrame:
    """``(basin_id, d, q)``: the file's name is the basin; codes and words are null; the first row of a day stays.

    A negative value makes the whole basin fail at read time with a clear message.
    """
    raw = spark.read.option("header", True).csv(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_seq", F.monotonically_increasing_id())
    text = F.trim(F.col(value_col))
    number = F.when(~text.isin(*missing), text.try_cast("double"))
    out = raw.select(F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1).alias("basin_id"), F.to_date(F.col(date_col).try_cast("timestamp")).alias("d"), F.nanvl(number, F.lit(None).cast("double")).alias("q"), "_seq")
    checked = out.withColumn("q", F.when(F.col("q") < 0, F.raise_error(F.format_string("negative flow in %s on %s", "basin_id", "d")).cast("double")).otherwise(F.col("q")))
    first = checked.where("d IS NOT NULL").groupBy("basin_id", "d").agg(F.min(F.struct("_seq", "q")).alias("s"))
    return first.select("basin_id", "d", "s.q")


def read_daily_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("basin_id", F.to_date("d").alias("d"), F.nanvl(F.col("q").cast("double"), F.lit(None).cast("double")).alias("q"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``(basin_id, ring, hole, seq, x, y)`` of all rings of a geometry, feature or collection of features; a polygon's later
    rings are its holes."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("v"))
    kind = F.try_variant_get("v", "$.type", "string")
    geometries = F.when(kind == "FeatureCollection", F.transform(F.try_variant_get("v", "$.features", "array<variant>"), lambda f: F.try_variant_get(f, "$.geometry", "variant"))).when(kind == "Feature", F.array(F.try_variant_get("v", "$.geometry", "variant"))).otherwise(F.array("v"))
    g = raw.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("basin_id"), F.posexplode(geometries).alias("feature", "g"))
    many = F.try_variant_get("g", "$.coordinates", "array<array<array<array<double>>>>")
    one = F.try_variant_get("g", "$.coordinates", "array<array<array<double>>>")
    polygons = F.when(F.try_variant_get("g", "$.type", "string") == "MultiPolygon", many).otherwise(F.array(one))
    rings = g.select("basin_id", "feature", F.posexplode(polygons).alias("part", "p")).select("basin_id", "feature", "part", F.posexplode("p").alias("k", "r"))
    rings = rings.select("basin_id", (F.col("feature").cast("long") * 1_000_000_000_000 + F.col("part") * 1_000_000 + F.col("k")).alias("ring"), (F.col("k") > 0).alias("hole"), F.posexplode("r").alias("seq", "c"))
    return rings.select("basin_id", "ring", "hole", "seq", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256, blob_sha1)``; the last as version control names a file's content."""
    b = spark.read.format("binaryFile").load(path)
    head = F.encode(F.concat(F.lit("blob "), F.col("length").cast("string"), F.lit("\0")), "UTF-8")
    return b.select("path", "length", F.sha2("content", 256).alias("sha256"), F.sha1(F.concat(head, "content")).alias("blob_sha1"))


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(name, status)``: ok, damaged, or missing, of each file that a manifest ``(name, sha256)`` lists."""
    f = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("got"))
    return manifest.join(f, "name", "left").select("name", F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("sha256"), "ok").otherwise("damaged").alias("status"))
