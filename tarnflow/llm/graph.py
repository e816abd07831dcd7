"""Connected components of link tables, without collecting them."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import _base


def release(df: DataFrame) -> None:
    """Let Spark delete shuffle files of stages whose results are written already: it does so when their handles are collected.

    The first collection on either side frees what holds the handles, the second the handles.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()


def roots(parents: DataFrame) -> DataFrame:
    """``(v, root)`` from an acyclic table ``(v, parent)`` with one parent each, by pointer doubling."""
    now = _base.materialize(parents.select("v", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("v").alias("root"), F.col("root").alias("above"))
        then = _base.materialize(now.join(up, "root", "left").select("v", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        now, moved = then.select("v", "root"), then.where("moved").limit(1).count()
        if not moved:
            return now


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for every end of the links ``(a, b)``; the root is the smallest vertex of its component.

    Each round takes the smallest label among the neighbours and then jumps along labels, so rounds grow with the
    logarithm of long chains; a vertex with very many links is handled by partial aggregates and split joins.
    """
    edges = _base.materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = _base.materialize(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        best = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("best"))
        up = labels.select(F.col("v").alias("best"), F.col("root").alias("above"))
        then = _base.materialize(best.join(up, "best", "left").select("v", F.least("best", F.coalesce("above", "best")).alias("next"), "root"), "labels")
        changed = then.where("next <> root").limit(1).count()
        labels = then.select("v", F.col("next").alias("root"))
        release(labels)
        if not changed:
            return labels
