"""Connected components and density clusters over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut


def _is_star_forest(stars: DataFrame) -> bool:
    """Every leaf points at one node, and that node at none: each star is a component."""
    ends = stars.select(F.col("u").alias("k"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(
        stars.select(F.col("v").alias("k"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    state = ends.groupBy("k").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return state.where("leaf > 1 or (leaf = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(i, j) → (node, component); ``component`` is the smallest node of its component.

    Alternating large-star / small-star rounds: every round is two aggregations and two
    joins whatever the degrees, and a long chain shrinks geometrically.
    """
    stars = cut(
        edges.where("i <> j").select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).distinct())
    while not _is_star_forest(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = cut(small.select("e.u", "e.v").where("u <> v").distinct())
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def dbscan(edges: DataFrame, min_samples: int = 2) -> DataFrame:
    """(i, j) → (node, label, core) of clustered nodes; noise is left out.

    A node is core with ``min_samples - 1`` neighbours. Cores linked to each other form a
    cluster, named after its smallest core; a border node takes the smallest name it touches.
    """
    both = edges.where("i <> j").select("i", "j").unionByName(
        edges.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    core = cut(both.groupBy("i").agg(F.count("*").alias("deg")).where(F.col("deg") + 1 >= min_samples).select("i"))
    from_core = both.join(core, "i")
    core_links = from_core.join(core.withColumnRenamed("i", "j"), "j")
    linked = components(core_links.select("i", "j")).withColumnRenamed("component", "label")
    single = core.withColumnRenamed("i", "node").join(linked, "node", "left_anti").select("node", F.col("node").alias("label"))
    cores = linked.unionByName(single)
    border = (
        from_core.join(core.withColumnRenamed("i", "j"), "j", "left_anti")
        .join(cores.withColumnRenamed("node", "i"), "i")
        .groupBy(F.col("j").alias("node")).agg(F.min("label").alias("label")))
    return cores.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
