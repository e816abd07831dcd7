"""What a map shows: lines clipped to views, thinned to a tolerance, and no more of them than a view can hold.

Lines are rows ``(line, seq, x, y)``, views are boxes ``(view_id, x0, y0, x1, y1)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators import network

#: Lines and polygons that a view shows at most, and degrees that a thinned line may be off.
MOST_LINES, MOST_POLYGONS, TOLERANCE = 25_000, 800, 0.0008


def _entered(view: str) -> tuple[Column, Column]:
    """From which share of a segment ``(ax, ay, bx, by)`` to which it lies in the view: each side of the box cuts one end."""
    first, last = [F.lit(0.0)], [F.lit(1.0)]
    for a, d, lo, hi in (("ax", F.col("bx") - F.col("ax"), "x0", "x1"), ("ay", F.col("by") - F.col("ay"), "y0", "y1")):
        low, high = F.try_divide(F.col(f"{view}.{lo}") - F.col(a), d), F.try_divide(F.col(f"{view}.{hi}") - F.col(a), d)
        beside = (F.col(a) < F.col(f"{view}.{lo}")) | (F.col(a) > F.col(f"{view}.{hi}"))
        first.append(F.when(d == 0, F.when(beside, 2.0).otherwise(0.0)).otherwise(F.least(low, high)))
        last.append(F.when(d == 0, 1.0).otherwise(F.greatest(low, high)))
    return F.greatest(*first), F.least(*last)


def clipped(lines: DataFrame, views: DataFrame) -> DataFrame:
    """``(view_id, line, piece, seq, x, y)``: the parts of each line inside each view; a line that leaves and comes back has
    several pieces.  What only touches a view in a point is one vertex.

    Segments meet views by tiles whose size follows from the segments, and are cut by themselves; a piece begins where a
    segment enters the view, or does not go on from the one before.
    """
    w = Window.partitionBy("line").orderBy("seq")
    s = lines.select("line", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx IS NOT NULL")
    boxes = s.withColumn("x0", F.least("ax", "bx")).withColumn("y0", F.least("ay", "by")).withColumn("x1", F.greatest("ax", "bx")).withColumn("y1", F.greatest("ay", "by"))
    size = max(network.tile_size(boxes), network.tile_size(views) / 64)
    met = network.in_tiles(views, size).alias("v").join(network.in_tiles(boxes, size).alias("s"), ["tx", "ty"]).where(network.boxes_overlap("v", "s"))
    first, last = _entered("v")
    met = met.withColumn("f", first).withColumn("t", last).where("f <= t").select(F.col("v.view_id").alias("view_id"), "line", "seq", "ax", "ay", "bx", "by", "f", "t").distinct()
    per = Window.partitionBy("view_id", "line").orderBy("seq")
    goes_on = (F.lag("seq").over(per) == F.col("seq") - 1) & (F.lag("t").over(per) == 1) & (F.col("f") == 0)
    met = met.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("piece", F.sum("new").over(per) - 1)
    at = lambda u: (F.col("ax") + u * (F.col("bx") - F.col("ax"))).alias("x"), lambda u: (F.col("ay") + u * (F.col("by") - F.col("ay"))).alias("y")
    ends = F.array(F.struct(F.col("seq"), at[0](F.col("f")), at[1](F.col("f")), (F.col("new") == 1).alias("is")), F.struct((F.col("seq") + 1).alias("seq"), at[0](F.col("t")), at[1](F.col("t")), (F.col("t") > F.col("f")).alias("is")))
    return met.select("view_id", "line", "piece", F.explode(ends).alias("e")).where("e.is").select("view_id", "line", "piece", "e.seq", "e.x", "e.y")


def simplified(lines: DataFrame, tolerance: float, keys: tuple[str, ...] = ("line",), max_rounds: int = 100_000) -> DataFrame:
    """``(*keys, seq, x, y)``: the vertices that Douglas and Peucker keep: ends, and wherever a vertex is farther than
    ``tolerance`` from the chord of those kept, the farthest one, the first of equals.

    All chords of all lines are split in the same round; a vertex knows the chord that it lies on, and goes with it once
    that is near enough.  So rounds are the depth of the splits, and no line is handled by itself.
    """
    key = list(keys)
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [f(c).over(w).alias(n) for f, names in ((F.first, ("a", "x1", "y1")), (F.last, ("b", "x2", "y2"))) for n, c in zip(names, ("seq", "x", "y"))]
    left = network.saved(lines.select(*key, "seq", F.col("x").alias("px"), F.col("y").alias("py"), *ends))
    kept = [left.where("seq = a OR seq = b").select(*key, "seq", F.col("px").alias("x"), F.col("py").alias("y"))]
    left = left.where("seq > a AND seq < b")
    far, _ = network.from_segment(F.col("px"), F.col("py"))
    for _ in range(max_rounds):
        worst = left.groupBy(*key, "a").agg(F.max(F.struct(far.alias("far"), (-F.col("seq")).alias("m"), F.col("px").alias("mx"), F.col("py").alias("my"))).alias("w")).where(F.col("w.far") > tolerance)
        split = network.saved(worst.select(*key, "a", (-F.col("w.m")).alias("m"), "w.mx", "w.my"))
        if split.isEmpty():
            break
        kept.append(split.select(*key, F.col("m").alias("seq"), F.col("mx").alias("x"), F.col("my").alias("y")))
        after = F.col("seq") > F.col("m")
        pick = lambda c, own, when: F.when(when, F.col(own)).otherwise(F.col(c)).alias(c)
        left = network.saved(left.join(split, [*key, "a"]).where("seq <> m").select(*key, "seq", "px", "py", F.when(after, F.col("m")).otherwise(F.col("a")).alias("a"), F.when(after, F.col("b")).otherwise(F.col("m")).alias("b"), pick("x1", "mx", after), pick("y1", "my", after), pick("x2", "mx", ~after), pick("y2", "my", ~after)))
    out = kept[0]
    for k in kept[1:]:
        out = out.union(k)
    return out


def shown(lines: DataFrame, weights: DataFrame, views: DataFrame, most: int = MOST_LINES, tolerance: float = TOLERANCE) -> DataFrame:
    """``(view_id, line, rank, n_found, piece, seq, x, y)``: of the lines that enter a view the ``most`` heaviest of ``weights
    (line, weight)``, ties by name, clipped and thinned; ``n_found`` counts all that enter it."""
    inside = network.saved(clipped(lines, views))
    w = Window.partitionBy("view_id")
    ranked = inside.select("view_id", "line").distinct().join(weights, "line", "left")
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("weight"), "line"))).withColumn("n_found", F.count("*").over(w)).where(F.col("rank") <= most).select("view_id", "line", "rank", "n_found")
    thin = simplified(inside.join(ranked.select("view_id", "line"), ["view_id", "line"], "left_semi"), tolerance, ("view_id", "line", "piece"))
    return thin.join(ranked, ["view_id", "line"]).select("view_id", "line", "rank", "n_found", "piece", "seq", "x", "y")
