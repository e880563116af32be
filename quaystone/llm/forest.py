"""Spanning forests by Borůvka-style minimum-edge contraction, as DataFrame joins.

Every round each component picks its smallest outgoing edge under a strict total
order (weight, then the two ends), all picks are contracted at once by pointer
jumping, and edges inside a component are dropped. The number of components with
edges at least halves per round, so there are O(log n) rounds. Every round is
written to the shared folder, which cuts the lineage. Nothing but the number of
remaining edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaystone.session import materialise


def _roots(hooks: DataFrame) -> DataFrame:
    """(v, root) from (v, parent), a forest in which roots are their own parent."""
    at = hooks
    while True:
        up = at.select(F.col("v").alias("parent"), F.col("parent").alias("above"))
        jumped = at.join(up, "parent", "left").select("v", F.coalesce("above", "parent").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
        jumped = materialise(jumped, "jump")
        moved = jumped.where("moved").limit(1).count()
        at = jumped.select("v", "parent")
        if not moved:
            return at.withColumnRenamed("parent", "root")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of an undirected graph given as (a, b, w).

    ``forest`` has the chosen edges (a, b, w); ``labels`` has (v, root) for each
    vertex of ``edges``. Loops and repeated edges are allowed, rows with a null
    end are left out, an empty graph gives two empty tables. The smaller weight,
    then the smaller ends, win.
    """
    clean = edges.where("a is not null and b is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    clean = materialise(clean, "edges")
    labels = clean.select(F.col("a").alias("v")).union(clean.select("b")).distinct().select("v", F.col("v").alias("root"))
    live = clean.where("a <> b").select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    forest = None
    while live.limit(1).count():
        pick = F.struct("w", "a", "b", "ca", "cb")
        out = live.select(F.col("ca").alias("v"), pick.alias("e")).union(live.select(F.col("cb").alias("v"), pick.alias("e")))
        best = materialise(out.groupBy("v").agg(F.min("e").alias("e")), "picks")
        chosen = best.select("e.a", "e.b", "e.w").distinct()
        forest = chosen if forest is None else forest.union(chosen)
        other = F.when(F.col("v") == F.col("e.ca"), F.col("e.cb")).otherwise(F.col("e.ca"))
        hooks = best.select("v", other.alias("parent"), "e")
        # two components that picked the same edge point at each other: the smaller one is the root
        mutual = hooks.select(F.col("v").alias("parent"), F.col("parent").alias("back"))
        hooks = hooks.join(mutual, "parent", "left").select("v", F.when((F.col("back") == F.col("v")) & (F.col("v") < F.col("parent")), F.col("v")).otherwise(F.col("parent")).alias("parent"))
        roots = _roots(materialise(hooks, "hooks"))
        to = roots.select(F.col("v").alias("root"), F.col("root").alias("to"))
        labels = materialise(labels.join(to, "root", "left").select("v", F.coalesce("to", "root").alias("root")), "labels")
        ra, rb = (roots.select(F.col("v").alias(c), F.col("root").alias("r" + c)) for c in ("ca", "cb"))
        live = live.join(ra, "ca").join(rb, "cb").where("rca <> rcb").groupBy(F.least("rca", "rcb").alias("ca"), F.greatest("rca", "rcb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
        live = materialise(live.select("e.a", "e.b", "e.w", "ca", "cb"), "live")
    return (clean.select("a", "b", "w").limit(0) if forest is None else forest), labels
