"""Connected components of a table of links, by minimum labels and pointer
jumping; no vertex, link or label passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.llm.common import join_unique, materialize


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every vertex of ``links`` (a, b): c is the smallest vertex that v
    reaches.  Null ends are ignored; self links give their vertex itself; an empty
    table gives no rows."""
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct(), "links")
    degree = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
    state = materialize(degree.select("v", F.least("v", "b").alias("c"), "n"), "labels")
    while True:
        seen = join_unique(both.withColumnRenamed("a", "v"), state, ["v"], "n")
        least = seen.groupBy(F.col("b").alias("v")).agg(F.min("c").alias("m"))
        step = materialize(state.join(least, "v").select("v", "n", F.col("c").alias("was"),
                                                         F.least("c", "m").alias("c")), "labels")
        heavy = step.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
        roots = materialize(step.select(F.col("v").alias("c"), F.col("c").alias("up")).join(heavy, "c"), "roots")
        state = materialize(join_unique(step, roots, ["c"], "k").select("v", F.col("up").alias("c"), "n", "was"),
                            "labels")
        if not state.filter(F.col("c") != F.col("was")).limit(1).count():
            return state.select("v", "c")
        state = state.drop("was")
